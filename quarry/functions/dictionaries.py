"""Rule lists as data: (class, pattern) in order of priority. All are parameters of what uses them.

Patterns keep to what Java, RE2 and Python read alike; words stand between ASCII boundaries, and a
bounded term of other letters (``between``) needs an ASCII letter or digit on both sides.
"""

from quarry.functions.text import any_of, between, either, starts, word

#: The classes and their terms.
TASK_TYPES = [
    ("Bug 修复", either(word("fix", "bug", "error", "broken"), between("修复", "报错", "出错", "问题"))),
    ("新功能开发", either(word("add", "create", "implement", "new"), between("新增", "添加", "实现", "开发"))),
    ("重构", either(word("refactor", "rewrite", "redesign"), between("重构", "重写", "改造"))),
    ("PRD/文档", either(word("prd", "doc", "readme"), r"(?i:(^|[^A-Za-z0-9_])write[^\n]*doc)", between("文档", "需求"))),
    ("配置/部署", either(word("deploy", "ci", "cd", "config", "setup"), between("部署", "配置", "安装"))),
    ("调研/探索", either(word("research", "explore", "evaluate", "compare"), between("调研", "探索", "对比", "评估"))),
    ("迁移/升级", either(r"(?i:(^|[^A-Za-z0-9_])(migrat|upgrad))", word("update"), between("迁移", "升级", "更新"))),
    ("测试", either(word("test", "spec"), between("测试", "验证"))),
]
EXAMPLE_NOISE = r"(?i:^(hello|hi|test|测试|ping|pong)\z)"

#: Relevance. The first is tested on the title, the next four on the title and the first
#: 500 characters, the last two on everything.
NOISE_TITLES = either(r"(?i:^background:)", r"(?i:^look_at:)", r"(?i:^hello\z)", r"(?i:^(echo|test)([^A-Za-z0-9_]|\z))", r"(?i:<local-command-caveat>)", r"^#\s*\z")
RELEVANCE_HEAD = [
    ("todo_fact", either(r"(^|[^A-Za-z0-9_])(TODO|FIXME)([^A-Za-z0-9_]|\z)", word("next step", "blocked", "in progress"), "待办|未完成|下一步|待跟进")),
    ("decision_rich", either(word("chose", "choose", "decide", "decided", "deciding", "instead of", "trade[- ]?off", "over"), r"选择[^\n]*而不是|改用|放弃|选择|决定|替代方案")),
    ("preference_rich", either(word("prefer", "avoid", "always", "never", "must", "should"), "偏好|禁止|总是|优先|不要")),
    ("pain_rich", either(word("error", "bug", "debug", "fix", "workaround", "root cause"), "报错|排查|修复|踩坑")),
]
RELEVANCE_WHOLE = [
    ("timeline_fact", either(word("deploy", "deployed", "release", "released", "ship", "shipped", "complete", "completed"), "上线|发布|完成|交付")),
    ("preference_rich", word("next.?js", "react", "vue", "tailwind", "shadcn", "drizzle", "prisma", "sqlite", "postgres", "postgresql", "express", "hono", "docker", "node.?js", "typescript", "playwright", "openai", "claude", "litellm", r"vercel\s*ai", "langchain", "mcp")),
]
RELEVANCE_HEAD_CHARS = 500

#: Event types, stances and the words they rest on.
EVENT_TYPES = [("delivery", any_of("deploy", "release", "上线", "发布", "交付")), ("incident", any_of("fix", "bug", "修复", "hotfix", "incident", "故障")), ("refactor", any_of("refactor", "重构")), ("milestone", any_of("review", "通过", "milestone", "完成", "merge"))]
POSITIVE = either(word("prefer", "preferred", "always", "standard", "default to", "prioriti[sz]e"), "偏好|优先|推荐|必须|严格|默认")
NEGATIVE = either(word("avoid", "never", "don't", "do not"), "禁止|不要|禁用|避免")
CONDITIONAL = either(word("if", "when", "unless", "only"), "如果|当|仅在|除非")
STANCES = [("avoid", NEGATIVE), ("prefer", POSITIVE)]
STACK_LABELS = either("前端|后端|数据库|部署|工具|技术栈", any_of("stack", "ai"), "组件|测试")
OPERATIONAL = either(word("ssh", "docker-compose"), r"(?i:/usr/local/bin/)", r"(?i:https?://)", r"(?i:\.github/workflows/)", word("workflow", "path", "endpoint", "port"), between("日志", "命令", "重启"), word("restart"))
PROMPT_LIKE = either(
    starts("task:", "expected outcome:", "required skills:", "required tools:", "must do:", "must not do:", "context:"), starts("you are", "research how to", "create", "build", "rewrite", "review", "i'?m building", whole=True),
    "OMO_INTERNAL_INITIATOR", any_of("EXPECTED OUTCOME", "MUST DO", "MUST NOT DO"), "PRD 全文",
)
GATE_PROMPT_LIKE = either(starts("task:", "expected outcome:", "required tools:", "required skills:", "must do:", "must not do:", "context:"), starts("you are", "research how to", "create", "build", "rewrite", "review", "i'?m building", whole=True))
COMPLETION = any_of("deploy", "delivered", "shipped", "merged", r"review[^\n]*passed", "上线", "交付", "发布", "合并")

#: Kinds of first messages, in order; the second also holds for messages over 500 characters.
FIRST_MESSAGES = [
    ("指令式（直接下达任务）", r"(?i:^(fix|add|create|implement|update|remove|delete|change|make|write|build|setup|configure|deploy|refactor|rewrite|migrate|把|帮|改|加|删|写|实现|修|重构|部署|配置))"),
    ("PRD 先行（贴需求文档）", either(r"^#\s", r"(?i:^(?:[^\n]|\n){0,96}(^|[^A-Za-z0-9_])prd([^A-Za-z0-9_]|\z))")),
    ("讨论式（提问/探讨）", either(r"(?i:^(how|what|why|should|can|is|do|which|这个|怎么|为什么|要不要|有没有|你觉得|如何|该|能不能))", r"\?\z")),
    ("链接/截图（贴 URL 或图）", either(r"^(?:[^\n]|\n){0,192}https?://", r"(?i:^(?:[^\n]|\n){0,195}\.(png|jpg|jpeg|gif|svg|webp)([^A-Za-z0-9_]|\z))")),
]

#: Technologies by category.
TECHNOLOGIES = [
    ("前端", "Next.js", word("next.?js", "nextjs", r"app\s*router")), ("前端", "React", word("react")), ("前端", "Vue", word("vue", "nuxt")),
    ("前端", "Tailwind CSS", word("tailwind")), ("前端", "shadcn/ui", word("shadcn")), ("前端", "Vite", word("vite", "vitepress")),
    ("后端", "Drizzle ORM", word("drizzle")), ("后端", "Prisma", word("prisma")), ("后端", "SQLite", word("sqlite")), ("后端", "PostgreSQL", word("postgres", "postgresql")),
    ("后端", "Express", word("express")), ("后端", "Hono", word("hono")), ("后端", "Node.js", word("node.?js", "nodejs")), ("后端", "node-cron", word("node-cron")),
    ("AI", "Claude", word("claude", "anthropic")), ("AI", "Gemini", word("gemini")), ("AI", "OpenAI", word("openai", "chatgpt")), ("AI", "LiteLLM", word("litellm")),
    ("AI", "Vercel AI SDK", word(r"vercel\s*ai", r"ai\s*sdk")), ("AI", "LangChain", word("langchain")),
    ("工具", "Playwright", word("playwright")), ("工具", "MCP", word("mcp")), ("工具", "GitHub Actions", word(r"github\s*actions?", "ci/cd")), ("工具", "TypeScript", word("typescript")),
    ("工具", "ESLint", word("eslint")), ("工具", "Vitest", word("vitest")),
    ("部署", "Docker", word("docker", "dockerfile")), ("部署", "Vercel", word("vercel")), ("部署", "GitHub Pages", word(r"github\s*pages")), ("部署", "NAS", word("nas", "synology")),
]
TECH_CATEGORIES = ("前端", "后端", "AI", "工具", "部署")
#: Lines in which a technology does not count.
TECH_EXCEPTIONS = {"React": r"(?i:@base-ui/react)", "Docker": r"(?i:docker\s+路径|docker command)"}

#: Focus domains, responsibility themes and role parts with their least shares.
FOCUS_DOMAINS = [
    ("DeFi", any_of("DeFi", "套利", "arbitrage", "对冲", "DEX", "swap", "流动性挖矿", "liquidity")),
    ("RWA 代币化", any_of("RWA", "代币化", "tokeniz", "Ondo", r"美股[^\n]*链上", r"链上[^\n]*美股", r"coin[^\n]*stock", r"stock[^\n]*token")),
    ("AI 工具链", either(word("LLM", "GPT"), any_of("MCP", r"multi[^\n]?agent", "toolchain", "RAG", r"prompt\s*engineer", "opencode", "openclaw", "智能代理", r"AI\s*Agent"))),
    ("量化交易", any_of("量化交易", "量化", "quant", r"trading\s*system", "回测", "backtest")),
    ("资金费率套利", any_of("资金费率", r"funding\s*rate", r"funding\s*arb")),
    ("知识库", any_of("知识库", r"knowledge\s*base", "知识检索", "知识助手")),
    ("预测市场", any_of("预测市场", r"prediction\s*market", "polymarket", "forecast")),
    ("个人能效工具", any_of(r"session[^\n]?memory", "数字分身", "个人工具", "能效工具", "productivity", "笔记", "转录", "会议记录")),
    ("语音转录", any_of("语音转录", "whisper", "transcri")),
    ("加密货币", any_of("加密货币", "crypto", "区块链", "blockchain", "链上", r"on[^\n]?chain", "web3")),
    ("Meme 交易", any_of("meme", r"pump\.fun", r"four\.meme")),
    ("风控", any_of("风控", r"risk\s*control", r"risk\s*management")),
    ("交易基础设施", any_of("交易系统", "撮合", "exchange", r"trading\s*infra", "broker", "保证金")),
    ("项目管理", any_of("PRD", "需求文档", "项目管理", "OKR", "roadmap", "里程碑", "milestone", "sprint")),
]
THEMES = [
    ("量化交易系统产品化", any_of("量化", "quant", "trading", "交易系统", "回测", "策略")),
    ("资金费率套利策略设计", any_of("资金费率", "funding", "套利", "arbitrage")),
    ("知识库助手建设", any_of("知识库", r"knowledge\s*base", "search", "检索", "PRD")),
    ("AI 工具链建设", either(word("LLM"), any_of("MCP", r"multi[^\n]?agent", "agent", "opencode", "openclaw", "davidbot", "toolchain", "RAG", "智能代理", "知识助手"))),
    ("语音转录与会议记录", any_of("转录", "whisper", "语音", "会议")),
    ("风控体系建设", any_of("风控", "risk")),
    ("RWA 代币化方案", any_of("RWA", "代币化", "tokeniz")),
    ("交易基础设施建设", any_of("撮合", "交易基础设施", "exchange", "api", "gateway")),
    ("企业内部工具落地", any_of("内部工具", r"企业[^\n]*工具", "bot", "助手")),
]
ROLE_PARTS = [
    ("产品经理", 0.2, any_of("产品", "PRD", "需求", "用户体验", "布局", "UI", "UX", "交互", "功能", "模块", "页面", "feature", "triage", "schedule")),
    ("开发者", 0.2, any_of("架构", "重构", "迁移", "部署", "数据库", "schema", "API", "性能", "算法", "SDK", "pipeline", "encoding", "分轨", "转录")),
    ("量化开发者", 0.1, any_of("量化", "套利", "资金费率", "funding", "对冲", "hedge", "交易", "trading", "持仓", "仓位", "做市", "Binance", "DEX", "swap")),
    ("AI工具链开发者", 0.1, either(word("LLM"), any_of("MCP", "agent", r"multi[^\n]?agent", "toolchain", "RAG", "prompt", "opencode", "openclaw", "知识库", "assistant", "智能", "模型路由", "embedding"))),
]
ROLE_JOIN = "兼"
AI_FOCUS = any_of("AI", "LLM", "MCP", "agent", "toolchain", "知识库")
ROLE_WORDS = any_of("产品", "开发", "PM", "engineer", "量化", "trader", "前端", "后端", "全栈", "设计", "运营", "研究", "分析", "manager", "lead", "架构", "CTO", "CEO", "founder", "负责人", "技术总监", "策略")
RESPONSIBILITY_WORDS = any_of("负责", "推动", "落地", "方案", "主导", "管理", "维护", "搭建", "设计", "开发", "对接", "协调", "优化", "交付", "owner", "lead", "drive")
FOCUS_WORDS = any_of("DeFi", "套利", "RWA", "代币化", "tokeniz", r"AI\s*Agent", "知识库", "量化交易", "资金费率", r"funding\s*rate", "企业内部工具", "内部工具", "会议记录", "语音转录", "加密货币", "crypto", "区块链", "blockchain", "交易系统", "trading", "meme", "NFT", "智能合约", r"smart\s*contract", "数据分析", "机器学习", "web3", "链上", "on-?chain", "做市", r"market\s*making")

#: What profile memory must not look like.
RAW_TEXT_CHARS, ROLE_TITLE_CHARS = 200, 30
MARKDOWN_NOISE = r"(?m:```|^\s*[-*+]\s+.+\n\s*[-*+]\s+|^\|.*\|$)"
AI_BEHAVIOUR = any_of(r"AI\s*助手", "Claude", "系统提示", r"model\s+behavior", r"system\s+prompt")
PROJECT_DESCRIPTION = any_of("这个项目", "本项目", "项目的核心价值", "项目价值")
LONG_SENTENCE = "[。！？；]"
ROLE_SENTENCE = "的|是|在|了|等"
FOCUS_LEAD_IN = r"^涉及[^\n]{8}"

#: Work style.
DIMENSIONS = {
    "交互方式": "交互风格", "交互风格": "交互风格", "interaction style": "交互风格", "与 ai 的交互方式": "交互风格", "对 ai 建议的反应": "AI 协作模式", "ai 协作模式": "AI 协作模式",
    "语言偏好": "语言偏好", "沟通风格": "语言偏好", "技术审美": "技术审美", "工作节奏": "工作节奏", "质量标准": "质量标准", "需求表达": "需求表达", "领域特征": "领域特征",
}
MISC_CATEGORY = r"(?i:^(其他|other)\z)"
BEHAVIOUR_VERBS = any_of("偏好", "习惯", "倾向", "模式", "风格", "方式", "喜欢", "频繁", "总是", "prefer", "tend", "habit", "pattern", "style")
INSTRUCTION = starts("task:", "expected outcome:", "must do:", "must not do:", "context:")
PROFILE_CATEGORIES = [
    ("语言偏好", any_of("中文", "英文", "language", "语言", "bilingual", "双语")),
    ("交互风格", any_of("prefer", "avoid", "always", "never", "沟通", "反馈", "简洁", "详细", "直接", "风格", "偏好", "禁止")),
    ("技术审美", any_of("design", "ui", "ux", "代码风格", "架构", "typescript", "react", "next", "tailwind", "审美", "技术")),
]
OTHER_CATEGORY = "其他"

#: Decisions, pain points, threads.
STATUS_WORDS = r"(?i:^(问题|已修复|TODO|Review|PRD已完成|Bug|修复|完成|待处理|待办)\z)"
META_COMMENTARY = either(r"无法确认[^\n]*决策", r"未发现[^\n]*决策", r"未达成[^\n]*决策", r"没有[^\n]*明确[^\n]*决策", any_of(r"insufficient\s+context", r"no\s+explicit\s+decision"), r"未提取到[^\n]*决策", r"无法从[^\n]*中提取")
GENERIC_DECISION = r"^(做了优化|改了实现|优化了一下|调整了|处理了|改了|修了|弄了)\z"
VAGUE_PROBLEM = r"(?i:^(这里有点麻烦|有个问题|不太行|有bug|出错了|不好用|有点问题)\z)"
VAGUE_THREAD = r"^(继续处理|看一下|处理一下|弄一下)\z"
EXECUTION_DETAIL = r"^\s*(修改|添加|删除|创建|更新|新增|移除|调整)\s*(了|过)?\s*(文件|代码|配置|函数|方法|接口|组件|表|字段)"
AI_SUBJECT = any_of(r"AI\s*助手", "Claude", "系统", "model")
BECAUSE = either(word("because"), "理由|原因")
DIAGNOSIS = either("诊断|原因", any_of("root cause", "because"))
SOLUTION = either("解决", any_of("fix", "solution"))
RECURRING = any_of("again", "recurring", "repeat", "反复", "经常", "总是")

#: Titles that views leave out.
LOW_VALUE_TITLES = either(
    starts("Explore", "Inspect", "Research", "Search", "Find", "Look", "Read", "Check", "Investigate", whole=True), r"(?i:^(?:hello|hi|test|测试|Tell me about yourself)\z)", r"^\[TEAM_STATUS\]",
    r"(?i:^Oracle([^A-Za-z0-9_][^\n]*)?[^A-Za-z0-9_]review([^A-Za-z0-9_]|\z))", r"^\[Pasted ~/", r"你是[^\n]*助手。通过", "^Evaluate the updated report",
)
SUBAGENT_TITLES = r"(?i:@[^\s)]*\s*subagent)"

#: Terms that occur in the driver's invented prose, for queries that should not be vacuous there.
PROSE_TERMS = [("article", word("the", "der", "la", "le")), ("conjunction", word("and", "und", "et", "y")), ("license", any_of("licen[sc]e", "copyright")), ("nas", word("nas", "was")), ("with", word("with", "mit", "avec", "con"))]
