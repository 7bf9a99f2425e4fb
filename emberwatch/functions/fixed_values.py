"""Word lists, sentences, patterns and formats that results must reproduce exactly."""

# --- characters that count as blank at the ends of a text, and line breaks -------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# --- log patterns -----------------------------------------------------------------------------
EXCEPTION_NAMES = (
    "[A-Z][\\w$]*(?:Error|Exception)|Traceback|Panic|Fatal|OOM|OutOfMemory|ConnectionRefused|"
    "Deadlock|SEGFAULT"
)
# every match of a pattern holds one of its parts
EXCEPTION_PARTS = (
    "Error", "Exception", "Traceback", "Panic", "Fatal", "OOM", "OutOfMemory", "ConnectionRefused", "Deadlock", "SEGFAULT",
)
FRAME_PARTS = ("at", "File")
LEVEL_PARTS = ("ERR", "FATAL", "CRITICAL", "WARN", "PANIC")
FRAME_LINE = (
    "^\\s*(?:at\\s+[\\w$.<>]+\\([^)]*\\)|File\\s+\"[^\"]+\",\\s+line\\s+\\d+.*|\\s+at\\s+.+:\\d+)"
)
KEY_VALUE = "\\b[\\w.-]+=[^\\s,]+"
IPV4 = "\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b"
LEVEL = "\\b(ERROR|ERR|FATAL|CRITICAL|WARN(?:ING)?|PANIC)\\b"
DEFAULT_LEVEL = "ERROR"
SERVICE_KEYS = ("service", "app", "module")
FALLBACK_CHARS = 280
MESSAGE_CHARS = 512

# --- text features ----------------------------------------------------------------------------
WORD = "[a-z][a-z0-9_]+"
TEXT_START, TEXT_END, TRIGRAM_PREFIX = "^", "$", "c3:"

# --- remediation catalog ----------------------------------------------------------------------
ACTIONS = (
    ("restart_service", "一键重启服务", "重启受影响的服务进程/容器", "low"),
    ("clear_cache", "清空缓存", "清空 Redis 缓存", "low"),
    ("scale_up", "扩容 +1", "扩容服务副本数", "medium"),
    ("rollback", "回滚版本", "回滚到上一版本", "high"),
    ("notify_oncall", "升级通知", "电话/企微通知值班高级工程师", "low"),
)
CACHE_WORDS = ("redis", "cache", "缓存")
MEMORY_WORDS = ("oom", "outofmemory", "heap", "内存")
RELEASE_WORDS = ("rollback", "版本", "deploy", "release")

# --- sentences of the plain-language explanation -----------------------------------------------
PLAIN_CACHE = (
    "后台缓存服务（Redis）出现了短暂故障，可能导致部分页面加载缓慢、登录状态丢失或验证码刷新失败，系统正在尝试自动恢复。"
)
PLAIN_INFERENCE = "AI 推理服务出现异常，可能导致智能推荐、图像识别等功能暂时不可用或结果异常，工程师正在处理。"
PLAIN_DATABASE = "后台数据库连接出现异常，可能导致提交订单、保存数据等操作失败，工程师正在紧急处理，请您稍后重试。"
PLAIN_MEMORY = "后台服务内存资源临时耗尽，系统可能会自动重启相关模块，期间相关功能会有几秒钟不可用，请稍后重试。"
PLAIN_DISK = "服务器存储空间已满，正在自动清理，期间文件上传/生成功能可能暂时不可用。"
PLAIN_CERTIFICATE = "安全证书相关配置异常，可能导致部分接口访问失败，工程师正在更新证书。"
PLAIN_DEFAULT = (
    "后台监测到一处服务异常，相关功能可能暂时不可用或响应变慢，工程师已收到通知并在处理中，给您带来不便非常抱歉。"
)

# --- names of error types ------------------------------------------------------------------------
TYPE_GPU, TYPE_QUEUE, TYPE_JVM = "GPU 显存异常", "消息队列积压", "JVM 内存溢出"
TYPE_DATABASE, TYPE_CACHE, TYPE_DEFAULT = "数据库连接异常", "Redis 缓存异常", "服务异常"

# --- user guides by root cause --------------------------------------------------------------------
GUIDE_GPU = "AI 推理服务出现异常，智能推荐/识别类功能可能暂时不可用，工程师正在处理。"
GUIDE_CACHE = "后台缓存服务短暂异常，可能导致登录态丢失或页面变慢，请稍后重试。"
GUIDE_MEMORY = "后台服务内存临时耗尽，系统正在自动恢复，相关功能请稍后重试。"
GUIDE_DEFAULT = "相关服务出现异常，工程师已介入处理，给您带来不便敬请谅解。"

# --- three-section answer ---------------------------------------------------------------------------
HEAD_PLAIN = "📢 【当前问题大白话翻译】"
HEAD_ACTIONS = "🛠️ 【您可以采取的行动】"
HEAD_ENGINEER = "👨‍💻 【技术排查参考（供工程师）】"
MARK_ACTIONS, MARK_ENGINEER = "🛠️", "👨‍💻"
USER_ACTIONS = (
    "如果您正在使用相关功能，请稍候 1-2 分钟后重试。\n"
    "如情况紧急，请回复 **1** 触发自动重启；非紧急可等待工程师自动修复。\n"
    "您也可以拨打一线值班热线：4000-XXX-XXX。"
)
GENERIC_STEPS = (
    "1. 确认服务进程与依赖组件（数据库 / 缓存 / 消息队列）状态；\n"
    "2. 查看监控大盘，定位异常发生的时间窗口与影响范围；\n"
    "3. 必要时执行回滚或重启，并保留现场日志供事后复盘。"
)
HISTORY_OPEN, HISTORY_CLOSE = "参考历史相似案例（", "…）：\n"

# --- prompts ---------------------------------------------------------------------------------------
NO_HISTORY = "(无相似历史经验，这是一个全新故障。)"
KNOWN_GUIDANCE = "这是一个已知问题，请充分参考历史经验，给出自信、精确的行动建议。"
NEW_GUIDANCE = (
    "这是一个首次出现的问题。在【大白话翻译】中如实告知正在排查；"
    "在【技术排查参考】中给出通用的、结构化的排查路径。"
)
KNOWN_LABEL, NEW_LABEL = "已匹配历史经验", "首次出现/无高置信匹配"
PROMPT_LOG, PROMPT_HISTORY = "当前原始日志:\n```\n", "\n```\n\n系统检索到的历史相似经验:\n"
PROMPT_MATCH, PROMPT_GUIDANCE = "\n\n匹配状态: ", "\n指导: "
PROMPT_CLUSTER = "\n聚合上下文: "
HISTORY_BLOCK = "【历史经验#%d】 (相似度 %.2f)\n历史日志: %s\n当时解决办法: %s\n---"
RESOLUTION_PROMPT = (
    "工程师处理记录:\n- 根因: %s\n- 解决办法: %s\n- 工程师: %s\n- 标签: %s\n\n"
    "触发该处理的原始日志:\n```\n%s\n```\n"
)
NO_TAGS = "(无)"

# --- labelled fields of a structured resolution ------------------------------------------------------
FIELD_LABELS = (
    ("error_type", "【错误类型】"),
    ("title", "【标题】"),
    ("root_cause", "【根因】"),
    ("user_guide", "【用户指引】"),
    ("engineer_guide", "【工程师指引】"),
)
TITLE_CHARS, TITLE_MORE, CAUSE_CHARS = 40, "…", 60
UNTYPED_INCIDENT = "Incident"
FALLBACK_USER_GUIDE = "联系值班工程师确认影响范围。"

# --- notifications -----------------------------------------------------------------------------------
ICON_KNOWN, ICON_NEW = "🟡", "🔴"
NOTICE_TITLE, UNKNOWN_SERVICE = "%s 服务异常告警 · %s", "未知服务"
NOTICE_BODY = (
    "**服务**: %s  **主机**: %s  **时间**: %s\n\n%s\n\n"
    "**您可以采取的行动**\n%s\n\n"
    "<details><summary>技术排查参考（点击展开）</summary>\n\n%s\n\n</details>\n\n"
)
NOTICE_HISTORY, NOTICE_HISTORY_LINE = "**历史相似案例**\n", "  - %s (相似度 %.2f)\n"
CLUSTER_TITLE, MANY_SERVICES = "📢 聚合告警 · %d 条相似异常 · %s", "多个服务"
CLUSTER_BODY = (
    "在过去 %d 分钟内检测到 **%d** 条高度相似的异常，涉及服务：**%s**。\n"
    "初步判断为同一根因引起（例如：共享的数据库/缓存抖动），正在合并处理。\n\n"
    "**示例日志：**\n%s"
)
EXAMPLE_LINE, EXAMPLE_CHARS, EXAMPLES = "- `%s`", 200, 3

# --- display -----------------------------------------------------------------------------------------
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
MATCH_LABELS = (
    ("matched", "命中历史", "success"),
    ("new_incident", "新增故障", "warning"),
    ("deposited", "已沉淀", "info"),
    ("aggregated", "已聚合", "default"),
)
STATUS_LABELS = (("open", "待处理", "error"), ("resolved", "已解决", "success"))
SEVERITY_CLASSES = (
    ("error", ("FATAL", "CRITICAL", "PANIC")),
    ("warning", ("ERROR", "ERR")),
    ("info", ("WARN", "WARNING")),
)
