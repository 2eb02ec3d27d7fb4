"""Who is this request? User-agent classification as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.sources.registry import Registry, lookup

# The shape of a complete browser user agent.
_BROWSER = (
    r"^Mozilla/5\.0 \((?:Windows|Macintosh|X11|Linux|iPhone|iPad|iPod|Android)[^)]*\) "
    r"(?:AppleWebKit/[\d.]+ \(KHTML, like Gecko\)|Gecko/\d+)[^()]*"
    r"(?:Chrome|CriOS|Safari|Firefox|FxiOS|Edg|OPR|Version)/[\d.]+"
)
_AUTOMATED = r"(?i)HeadlessChrome|PhantomJS|Lighthouse|Puppeteer|Playwright"


def browser_shaped(ua: Column) -> Column:
    return ua.rlike(_BROWSER) & ~F.lower(ua).contains("compatible;") & ~ua.rlike(_AUTOMATED)


def signature_host(header: Column) -> Column:
    return F.lower(F.regexp_extract(header, r"(?i)https?://([a-z0-9.-]+)", 1))


def token_pattern(registry: Registry) -> str:
    """One alternation of every token, longest first (Java takes the first alternative that fits)."""
    tokens = sorted(registry.tokens, key=lambda t: (-len(t), t))
    return "|".join(re.escape(t) for t in tokens)


def registered_bot(registry: Registry, ua: Column) -> Column:
    """Best registered crawler named in a user agent: highest priority, then first in the text."""
    pattern = token_pattern(registry)
    if not pattern:
        return F.lit(None).cast("string")
    text = F.lower(ua)
    owner = {t: b["id"] for t, b in registry.tokens.items()}
    rank = {t: registry.priority(b) for t, b in registry.tokens.items()}
    best = F.array_max(
        F.transform(
            F.regexp_extract_all(text, F.lit(f"({pattern})"), 1),
            lambda t, i: F.struct(lookup(rank, t).alias("p"), (-i).alias("at"), lookup(owner, t).alias("bot")),
        )
    )
    # most requests name no crawler: they stop at the compiled test
    return F.when(text.rlike(pattern), best["bot"])


def with_agent(requests: DataFrame, registry: Registry, signature: str | None = None,
               address_bot: str | None = None) -> DataFrame:
    """Add bot, cls, sig and by_address from the `ua` column.

    The tests on the text become columns first, so each is run once per
    request however many results depend on it.
    """
    ua = F.coalesce("ua", F.lit(""))
    rows = requests.withColumn("_named", registered_bot(registry, ua)).withColumn(
        "_generic", F.col("_named").isNull() & ~browser_shaped(ua) & ua.rlike("(?i)" + registry.bot_pattern)
    ).withColumn("_hinted", F.col("_generic") & ua.rlike("(?i)" + registry.hint_pattern))
    named, generic, hinted = F.col("_named"), F.col("_generic"), F.col("_hinted")
    sig = F.coalesce(signature, F.lit("")) if signature else F.lit("")
    signed = sig != ""
    signers = {h.lower(): b["id"] for b in registry.bots for h in b["signature_hosts"]}
    signed_bot = F.coalesce(lookup(signers, signature_host(sig)), F.lit("_signed"))
    by_address = F.col(address_bot) if address_bot else F.lit(None).cast("string")
    return rows.withColumns({
        "bot": F.when(named.isNotNull(), named).when(signed, signed_bot).when(hinted, "_potential").when(generic, "_unknown")
        .otherwise(F.coalesce(by_address, F.lit(""))),
        "cls": F.when(named.isNotNull(), bot_class(registry, named)).when(signed, "ai").when(hinted, "potential")
        .when(generic, "unknown").when(by_address.isNotNull(), bot_class(registry, by_address)).otherwise("human"),
        "sig": named.isNull() & signed,
        "by_address": named.isNull() & ~signed & ~generic & by_address.isNotNull(),
    }).drop("_named", "_generic", "_hinted")


def bot_class(registry: Registry, bot: Column) -> Column:
    cls = {
        b["id"]: "ai" if b["ai"] else "search" if b["category"] == "search" else "known" for b in registry.bots
    }
    return lookup(cls, bot)


def confidence(registry: Registry, cls: Column, vstate: Column, bot: Column) -> Column:
    """How sure the label is."""
    return (
        F.when((vstate == "verified") | (cls == "spoofed") | (vstate == "failed"), "high")
        .when(cls.isin("potential", "unknown"), "low")
        .when(F.coalesce(registry.attr(bot, "confidence"), F.lit("")) == "high", "medium")
        .otherwise("low")
    )


# Which part of an agent names it.
def agent_token(ua: Column) -> Column:
    """The name an unknown agent gives itself."""
    rest = F.regexp_replace(ua, r"^Mozilla/[\d.]+\s*(\([^)]*\))?\s*", "")
    return F.regexp_extract(rest, r"([A-Za-z][A-Za-z0-9._-]{2,40})(?:/[\d.]+)?", 1)


# What a category of crawler is for.
PURPOSE = {
    "ai_training": "Model training",
    "ai_search": "Search — powers answers",
    "ai_user": "User-triggered fetch",
    "ai_agent": "Agent acting for a user",
    "ai_other": "Other AI use",
    "search": "Search engine",
}


def purpose(category: Column) -> Column:
    return F.coalesce(lookup(PURPOSE, category), category)
