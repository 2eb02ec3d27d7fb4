"""Crawler and assistant registries: layered, validated, small by contract.

A registry is a dimension of at most a few hundred records. It is loaded and
validated with DataFrame operations and then held as a `Registry`, whose
columns become literal maps and IN lists inside the big scans, so no join (and
no shuffle of the request table) is needed to look a crawler up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MAX_BOTS = 5000  # a registry above this is refused, not truncated

CATEGORIES = (
    "ai_training", "ai_search", "ai_user", "ai_agent", "ai_other",
    "search", "seo", "social", "monitor", "other",
)

BOT_SCHEMA = """
    id string, name string, provider string, category string, ai boolean,
    patterns array<string>, robots_tokens array<string>, robots_only boolean,
    ip_only boolean, signed_only boolean, deprecated boolean,
    respects_robots boolean, ranges array<string>, rdns array<string>,
    signature_hosts array<string>, confidence string
"""
REFERRER_SCHEMA = "id string, name string, hosts array<string>, utm array<string>"

# Names of bots that are not in the registry.
SYNTHETIC = {
    "_unknown": "Unrecognised bots",
    "_potential": "Possible AI crawlers",
    "_signed": "Signed agent (unknown operator)",
}

# Generic automated-client pattern.
BOT_PATTERN = (
    r"bot\b|bot/|crawl|spider|slurp|scrap|fetcher|archiver|indexer|python-|python/|curl/|wget"
    r"|go-http-client|java/|okhttp|axios|node-fetch|undici|headless|phantomjs|httpclient|libwww"
    r"|scrapy|aiohttp|httpx|guzzle|^mozilla/5\.0$|^$"
)
# Our own pattern for agents whose name suggests AI use.
AI_HINT_PATTERN = r"(?:^|[^a-z])ai(?:[^a-z]|$)|ai-?bot|llm|gpt|genai|(?:^|[^a-z])rag(?:[^a-z]|$)"


def _bot(id, name, provider, category, patterns=(), robots=(), **extra):
    record = dict(
        id=id, name=name, provider=provider, category=category, ai=category.startswith("ai_"),
        patterns=list(patterns), robots_tokens=list(robots), robots_only=False, ip_only=False,
        signed_only=False, deprecated=False, respects_robots=None, ranges=[], rdns=[],
        signature_hosts=[], confidence="high",
    )
    record.update(extra)
    return record


# Seed registry from public operator documentation.
SEED_BOTS = [
    _bot("gptbot", "GPTBot", "OpenAI", "ai_training", ["GPTBot"], ["GPTBot"], respects_robots=True,
         ranges=["https://openai.com/gptbot.json"]),
    _bot("oai-searchbot", "OAI-SearchBot", "OpenAI", "ai_search", ["OAI-SearchBot"], ["OAI-SearchBot"],
         respects_robots=True, ranges=["https://openai.com/searchbot.json"]),
    _bot("chatgpt-user", "ChatGPT-User", "OpenAI", "ai_user", ["ChatGPT-User"], ["ChatGPT-User"],
         ranges=["https://openai.com/chatgpt-user.json"]),
    _bot("chatgpt-agent", "ChatGPT agent", "OpenAI", "ai_agent", signed_only=True,
         signature_hosts=["chatgpt.com"]),
    _bot("claudebot", "ClaudeBot", "Anthropic", "ai_training", ["ClaudeBot"], ["ClaudeBot"], respects_robots=True),
    _bot("claude-searchbot", "Claude-SearchBot", "Anthropic", "ai_search", ["Claude-SearchBot"],
         ["Claude-SearchBot"], respects_robots=True),
    _bot("claude-user", "Claude-User", "Anthropic", "ai_user", ["Claude-User"], ["Claude-User"],
         respects_robots=True),
    _bot("perplexitybot", "PerplexityBot", "Perplexity", "ai_search", ["PerplexityBot"], ["PerplexityBot"],
         respects_robots=True, ranges=["https://www.perplexity.com/perplexitybot.json"]),
    _bot("perplexity-user", "Perplexity-User", "Perplexity", "ai_user", ["Perplexity-User"], ["Perplexity-User"],
         ranges=["https://www.perplexity.com/perplexity-user.json"]),
    _bot("meta-externalagent", "Meta-ExternalAgent", "Meta", "ai_training", ["meta-externalagent"],
         ["meta-externalagent"]),
    _bot("bytespider", "Bytespider", "ByteDance", "ai_training", ["Bytespider"], ["Bytespider"],
         confidence="medium"),
    _bot("ccbot", "CCBot", "Common Crawl", "ai_training", ["CCBot"], ["CCBot"], respects_robots=True),
    _bot("amazonbot", "Amazonbot", "Amazon", "ai_other", ["Amazonbot"], ["Amazonbot"], respects_robots=True),
    _bot("mistralai-user", "MistralAI-User", "Mistral AI", "ai_user", ["MistralAI-User"], ["MistralAI-User"],
         respects_robots=True),
    _bot("google-cloudvertexbot", "Google-CloudVertexBot", "Google", "ai_other", ["Google-CloudVertexBot"],
         ["Google-CloudVertexBot"], respects_robots=True),
    _bot("googleother", "GoogleOther", "Google", "ai_other", ["GoogleOther"], ["GoogleOther"],
         respects_robots=True),
    _bot("google-extended", "Google-Extended", "Google", "ai_training", [], ["Google-Extended"],
         robots_only=True, respects_robots=True),
    _bot("google-agent", "Google agent", "Google", "ai_agent", ip_only=True,
         ranges=["https://developers.google.com/static/search/apis/ipranges/user-triggered-agents.json"]),
    _bot("applebot", "Applebot", "Apple", "search", ["Applebot"], ["Applebot"], respects_robots=True,
         rdns=[".applebot.apple.com"]),
    _bot("applebot-extended", "Applebot-Extended", "Apple", "ai_training", [], ["Applebot-Extended"],
         robots_only=True, respects_robots=True),
    _bot("duckassistbot", "DuckAssistBot", "DuckDuckGo", "ai_search", ["DuckAssistBot"], ["DuckAssistBot"],
         respects_robots=True),
    _bot("googlebot", "Googlebot", "Google", "search", ["Googlebot"], ["Googlebot"], respects_robots=True,
         rdns=[".googlebot.com", ".google.com"],
         ranges=["https://developers.google.com/static/search/apis/ipranges/googlebot.json"]),
    _bot("bingbot", "Bingbot", "Microsoft", "search", ["bingbot"], ["bingbot"], respects_robots=True,
         rdns=[".search.msn.com"], ranges=["https://www.bing.com/toolbox/bingbot.json"]),
    _bot("duckduckbot", "DuckDuckBot", "DuckDuckGo", "search", ["DuckDuckBot"], ["DuckDuckBot"],
         respects_robots=True),
    _bot("ahrefsbot", "AhrefsBot", "Ahrefs", "seo", ["AhrefsBot"], ["AhrefsBot"], respects_robots=True),
    _bot("semrushbot", "SemrushBot", "Semrush", "seo", ["SemrushBot"], ["SemrushBot"], respects_robots=True),
    _bot("facebookexternalhit", "Facebook link preview", "Meta", "social", ["facebookexternalhit"],
         ["facebookexternalhit"]),
    _bot("uptimerobot", "UptimeRobot", "UptimeRobot", "monitor", ["UptimeRobot"]),
]

SEED_REFERRERS = [
    dict(id="chatgpt", name="ChatGPT", hosts=["chatgpt.com", "chat.openai.com"], utm=["chatgpt.com", "chatgpt"]),
    dict(id="perplexity", name="Perplexity", hosts=["perplexity.ai", "www.perplexity.ai"], utm=["perplexity"]),
    dict(id="gemini", name="Gemini", hosts=["gemini.google.com"], utm=["gemini"]),
    dict(id="copilot", name="Copilot", hosts=["copilot.microsoft.com"], utm=["copilot"]),
    dict(id="claude", name="Claude", hosts=["claude.ai"], utm=["claude"]),
    dict(id="meta-ai", name="Meta AI", hosts=["meta.ai", "www.meta.ai"], utm=["meta-ai"]),
    dict(id="mistral", name="Le Chat", hosts=["chat.mistral.ai"], utm=["mistral"]),
    dict(id="deepseek", name="DeepSeek", hosts=["chat.deepseek.com"], utm=["deepseek"]),
]

# Assistant whose visits belong to an operator.
ASSISTANT_OF = {
    "OpenAI": "chatgpt",
    "Perplexity": "perplexity",
    "Google": "gemini",
    "Microsoft": "copilot",
    "Anthropic": "claude",
    "Meta": "meta-ai",
    "Mistral AI": "mistral",
    "DeepSeek": "deepseek",
}


def _clean_list(col: Column, pattern: str | None = None) -> Column:
    """All usable entries, each once."""
    ok = lambda s: (
        (F.length(s) > 0) & ~s.rlike(r"[\x00-\x1F\x7F]")
        & (s.rlike(pattern) if pattern else F.lit(True))
    )
    trimmed = F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, ok))


def validate_bots(raw: DataFrame) -> DataFrame:
    """Clean records; unusable entries are dropped."""
    category = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("other")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    clean = raw.filter(F.col("id").rlike(r"^[a-z0-9][a-z0-9-]{1,39}$")).select(
        "id",
        F.trim(F.coalesce("name", "id")).alias("name"),
        F.trim(F.coalesce("provider", F.lit(""))).alias("provider"),
        category.alias("category"),
        (flag("ai") | category.startswith("ai_")).alias("ai"),
        _clean_list(F.col("patterns")).alias("patterns"),
        _clean_list(F.col("robots_tokens"), r"^[A-Za-z0-9 ._/-]+$").alias("robots_tokens"),
        flag("robots_only").alias("robots_only"),
        flag("ip_only").alias("ip_only"),
        flag("signed_only").alias("signed_only"),
        flag("deprecated").alias("deprecated"),
        "respects_robots",
        _clean_list(F.col("ranges"),
                    r"(?i)^https://[a-z0-9.-]+\.[a-z]{2,}(/[\x21-\x7E]*)?$").alias("ranges"),
        _clean_list(F.col("rdns"), r"(?i)^\.[a-z0-9.-]+$").alias("rdns"),
        _clean_list(F.col("signature_hosts"), r"(?i)^[a-z0-9.-]+$").alias("signature_hosts"),
        F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence"))
        .otherwise("medium").alias("confidence"),
    )
    return clean.filter(
        (F.size("patterns") > 0) | F.col("ip_only") | F.col("signed_only") | F.col("robots_only")
    )


def layer_bots(bundled: DataFrame, remote: DataFrame | None = None, custom: DataFrame | None = None,
               bundled_version: str = "0", remote_version: str = "0") -> DataFrame:
    """Later layers win per id; the remote layer replaces the bundled one when it is not older."""
    base = validate_bots(bundled).withColumn("origin", F.lit("bundled"))
    if remote is not None and _version(remote_version) >= _version(bundled_version):
        base = validate_bots(remote).withColumn("origin", F.lit("remote"))
    layers = base.withColumn("layer", F.lit(0))
    if custom is not None:
        layers = layers.unionByName(
            validate_bots(custom).withColumn("origin", F.lit("custom")).withColumn("layer", F.lit(1))
        )
    newest = Window.partitionBy("id").orderBy(F.desc("layer"), F.desc("name"))
    return (
        layers.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r", "layer")
    )


def _version(v: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", v))


def validate_referrers(raw: DataFrame) -> DataFrame:
    lowered = lambda c: F.transform(c, F.lower)
    return raw.filter(F.col("id").rlike(r"^[a-z0-9-]{2,20}$")).select(
        "id",
        F.trim(F.coalesce("name", "id")).alias("name"),
        lowered(_clean_list(F.col("hosts"), r"(?i)^[a-z0-9.-]+$")).alias("hosts"),
        lowered(_clean_list(F.col("utm"), r"(?i)^[a-z0-9._-]+$")).alias("utm"),
    )


def read_registry_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of crawler records."""
    return spark.read.schema(BOT_SCHEMA).option("multiLine", True).json(path)


def promote_agent(ua: str, token: str, id: str, name: str, category: str) -> dict:
    """A custom entry that tracks a so far unknown agent; its token must occur in the user agent."""
    if token.lower() not in ua.lower():
        raise ValueError("the token does not occur in the user agent")
    return _bot(id, name, "", category, [token], confidence="medium")


@dataclass(frozen=True)
class Registry:
    bots: tuple[dict, ...]
    referrers: tuple[dict, ...] = ()
    bot_pattern: str = BOT_PATTERN
    hint_pattern: str = AI_HINT_PATTERN
    _by_id: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self._by_id.update({b["id"]: b for b in self.bots})

    @classmethod
    def seed(cls) -> "Registry":
        return cls(tuple(SEED_BOTS), tuple(SEED_REFERRERS))

    @classmethod
    def from_frames(cls, bots: DataFrame, referrers: DataFrame | None = None) -> "Registry":
        """Collect a layered registry; its size is checked before it reaches the driver."""
        rows = bots.limit(MAX_BOTS + 1).collect()
        if len(rows) > MAX_BOTS:
            raise ValueError(f"a crawler registry may hold at most {MAX_BOTS} records")
        refs = [] if referrers is None else referrers.limit(MAX_BOTS + 1).collect()
        if len(refs) > MAX_BOTS:
            raise ValueError(f"a referrer registry may hold at most {MAX_BOTS} records")
        return cls(
            tuple(r.asDict() for r in sorted(rows, key=lambda r: r["id"])),
            tuple(r.asDict() for r in sorted(refs, key=lambda r: r["id"])),
        )

    def get(self, id: str) -> dict | None:
        return self._by_id.get(id)

    def ids(self, group: str) -> list[str]:
        """Ids of a group: 'ai', or a category."""
        return [b["id"] for b in self.bots
                if (b["ai"] if group == "ai" else b["category"] == group)]

    @property
    def ai_ids(self) -> list[str]:
        """AI crawlers plus the placeholder for signed agents of unknown operators."""
        return self.ids("ai") + ["_signed"]

    @property
    def user_ids(self) -> list[str]:
        return self.ids("ai_user") + self.ids("ai_agent")

    # literal lookups -----------------------------------------------------

    def is_ai(self, bot: Column) -> Column:
        return bot.isin(*self.ai_ids)

    def attr(self, bot: Column, name: str) -> Column:
        """Attribute of a crawler as a literal map lookup (null when unregistered)."""
        return lookup({b["id"]: b[name] for b in self.bots if b[name] is not None}, bot)

    def category(self, bot: Column) -> Column:
        return self.attr(bot, "category")

    def label(self, bot: Column) -> Column:
        names = {b["id"]: b["name"] for b in self.bots} | SYNTHETIC
        return F.coalesce(lookup(names, bot), bot)

    def referrer_name(self, source: Column) -> Column:
        return F.coalesce(lookup({r["id"]: r["name"] for r in self.referrers}, source), source)

    def priority(self, bot: dict) -> int:
        base = 300 if bot["ai"] else 200 if bot["category"] == "search" else 100
        return base - (50 if bot["deprecated"] else 0)

    @property
    def tokens(self) -> dict[str, dict]:
        """Lower-cased user-agent token -> bot; the last entry to claim a token keeps it."""
        return {p.lower(): b for b in self.bots for p in b["patterns"]}

    @property
    def hosts(self) -> dict[str, str]:
        return {h: r["id"] for r in self.referrers for h in r["hosts"]}

    @property
    def utm(self) -> dict[str, str]:
        return {u: r["id"] for r in self.referrers for u in r["utm"]}

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [f.split()[0] for f in BOT_SCHEMA.replace("\n", " ").split(",")]
        return spark.createDataFrame([tuple(b[n] for n in names) for b in self.bots], BOT_SCHEMA)


def _sql(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small literal map; null when the key is absent."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)
