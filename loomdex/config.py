"""Parameters of the retrieval engine. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# What the results depend on.
NOISE_PATTERNS = (
    r"^\s*(?:page\s+)?\d+\s*(?:of\s+\d+)?\s*$",
    r"^\s*[-–—.]\s*\d+\s*[-–—.]\s*$",
    r"\.{4,}\s*\d*\s*$",
    r"^\s*\.{3,}\s*$",
    r"©.*?(?:reserved|inc\.|corp\.|ltd)",
    r"\ball rights reserved\b",
    r"\bconfidential(?:ity)?\b",
    r"this document is provided.{0,40}\bas is\b",
    r"\bdell\s+(?:inc\.|technologies)\b.{0,40}\ball rights\b",
    r"do not (?:copy|distribute|reproduce)",
    r"^\s*draft\s*$",
)

# Words that carry no content in a Chinese question.
STOPWORDS = (
    "的", "了", "和", "是", "在", "我", "你", "他", "它", "有", "与", "及", "或", "等", "就", "都", "而", "该", "其", "对", "为", "被", "把", "吗", "呢", "啊", "怎么", "如何",
    "什么", "哪些", "哪个", "为什么", "多少", "一个", "一下", "这个", "那个", "我们", "你们", "他们", "这里", "那里", "还", "要", "会", "能", "可以", "请", "用", "给", "让", "不", "没", "很",
    "也", "又", "再", "才", "只", "最",
)

# Phrases that appeal to knowledge outside the context.
INFERENCE_PHRASES = (
    "据我所知", "根据我的了解", "根据我的知识", "根据我的经验", "我推测", "我猜", "我估计", "我印象中", "我记得", "一般来说", "通常情况", "理论上", "普遍认为",
)

# Dotted abbreviations that aren't identifiers.
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "vs", "fig", "no", "approx", "inc", "ltd", "al", "u.s.a", "u.s", "a.m", "p.m", "mr", "ms", "dr", "st", "jr", "sr",
)

# Words before a full stop that don't end a sentence.
SENTENCE_ABBREVIATIONS = (
    "e.g", "i.e", "fig", "no", "vs", "etc", "al", "mr", "dr", "st", "inc", "ltd", "sec", "eq", "ref", "approx",
)

# Terms of the domain and their translations, in the order of lookup.
TERMS = {
    "快照": "snapshot", "克隆": "clone", "复制": "replication", "复制技术": "replication", "卷": "volume", "精简": "thin", "精简克隆": "thin clone",
    "存储": "storage", "存储池": "storage pool", "共享": "share", "文件共享": "file sharing", "升级": "upgrade", "降级": "downgrade", "健康检查": "health check",
    "告警": "alert", "事件": "event", "日志": "journal log", "硬件": "hardware", "更换": "replace replacement", "电池": "BBU battery", "电池组": "BBU",
    "BBU": "BBU battery backup", "节点": "node", "模块": "module", "机箱": "enclosure", "扩展柜": "expansion enclosure", "底座": "base enclosure",
    "IO 模块": "IO module", "接口卡": "port card", "4 端口卡": "4-port card", "集群": "cluster", "镜像": "mirror replication",
    "VMware 集成": "VMware vSphere virtualization", "快照策略": "snapshot policy", "快照计划": "snapshot schedule", "导入": "import", "外部存储": "external storage",
    "容量": "capacity capacity expansion", "扩容": "expansion capacity", "性能": "performance", "监控": "monitor", "REST API": "REST API",
    "命令行": "CLI command", "脚本": "script", "服务脚本": "service script svc", "出厂": "factory", "出厂状态": "factory state", "重置": "reset factory reset",
    "故障": "fault faulted failure", "故障处理": "troubleshoot", "卸载": "unmount detach", "挂载": "mount attach", "备份": "backup", "恢复": "recovery restore",
    "时间同步": "NTP time sync", "时间偏差": "time skew", "失败": "failure failed error", "重启": "reboot restart", "型号": "model model number",
    "规格": "specifications spec", "查看": "view check display", "状态": "status state", "变更": "change", "变更内容": "what's new change list",
    "版本": "version release", "升级失败": "upgrade failure failed upgrade", "安装": "install installation", "配置": "configure configuration", "创建": "create",
    "删除": "delete remove", "端口": "port", "磁盘": "disk drive", "控制器": "controller", "电源": "power supply PSU", "风扇": "fan",
    "温度": "temperature thermal", "许可证": "license", "密码": "password", "证书": "certificate", "主机": "host", "保护": "protection", "迁移": "migration migrate",
}

#: (most pages, child tokens, overlap tokens, parent tokens; 0: no parents)
TIERS = (("short", 19, 512, 64, 0), ("medium", 100, 768, 96, 0), ("long", 10**9, 512, 64, 1536))


@dataclass(frozen=True)
class Settings:
    dense_top_k: int = 20
    sparse_top_k: int = 20
    rrf_k: int = 60
    final_top_n: int = 4
    vote_cap: int = 3
    sparse_min: float = 8.0
    require_token: bool = True
    ubiquitous_ratio: float = 0.10
    rewrite: bool = True
    hyde: bool = True
    mmr: bool = True
    mmr_lambda: float = 0.6
    hyde_cache_size: int = 200
    hyde_max_words: int = 45
    sparse_fallback_only: bool = False
    dense_min: float = 0.60
    max_context_tokens: int = 2800
    heading_break_ratio: float = 0.6
    caption_min_tokens: int = 40
    code_max: int = 768
    table_max: int = 2048
    min_chunk: int = 15
    header_footer_ratio: float = 0.30
    header_footer_zone: float = 0.12
    toc_line_ratio: float = 0.35
    extensions: tuple[str, ...] = ("pdf", "md", "txt", "docx", "html", "htm")
    excluded: tuple[str, ...] = ("node_modules", ".venv", "venv", "__pycache__", ".git", "site-packages", "_build", "data", "logs")
    newest_per_root: int = 500  # of the report s02; the index takes all files
    max_file_bytes: int = 50 * 1024 * 1024


DEFAULT = Settings()
