"""Content quality: relevance, authority, readability, completeness, freshness, issues, the ingestion gate.

All are Column expressions over text, source_type, domain and created_at; the date that ages are counted to is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T

# Weights and word lists that the scores are defined by.
AUTHORITY = {"chat_channel": 0.8, "documentation": 0.9, "official_website": 0.9, "github_repository": 0.8, "wikipedia": 0.7, "stackoverflow": 0.6, "blog_post": 0.5, "forum": 0.4, "unknown": 0.3}
TECHNICAL = ["implementation", "configuration", "documentation", "specification"]
AUTHORITATIVE = ["official", "documentation", "guide", "manual", "specification"]
LOW_QUALITY = ["lorem ipsum", "placeholder", "test content", "todo", "fixme"]
INCOMPLETE = ["todo", "fixme", "placeholder", "coming soon", "under construction", "...", "tbd", "to be determined", "[placeholder]"]
PLACEHOLDERS = ["lorem ipsum", "placeholder", "test content", "sample text"]
UNFINISHED = ["todo", "fixme", "coming soon", "under construction"]
THRESHOLDS = {"chat_channel": 0.3, "url_webpage": 0.4, "pdf_document": 0.6, "markdown_file": 0.5, "code_file": 0.3}
HEADERS, LISTS = "(?m)^#+\\s", "(?m)^\\s*[-*•]\\s"


def hits(low: Column, wanted: list[str]) -> Column:
    return sum((F.contains(low, F.lit(w)).cast("int") for w in wanted), F.lit(0))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def relevance(text: Column, source_type: Column) -> Column:
    low = F.lower(text)
    source = F.when(source_type.isin("documentation", "official_website"), 0.1).when(source_type == "chat_channel", 0.05).otherwise(0.0)
    return clamp(0.5 + F.least(hits(low, TECHNICAL) * 0.1, F.lit(0.3)) + F.least(hits(low, AUTHORITATIVE) * 0.05, F.lit(0.2)) - hits(low, LOW_QUALITY) * 0.1 + source)


def authority(source_type: Column, domain: Column | None = None, official: Column | None = None, verified: Column | None = None) -> Column:
    base = F.coalesce(*[F.when(source_type == k, v) for k, v in AUTHORITY.items()], F.lit(0.3))
    for flag in (official, verified, None if domain is None else domain.rlike("\\.(gov|edu|org)")):
        if flag is not None:
            base = base + F.when(flag, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), base)


def counted(docs: DataFrame) -> DataFrame:
    """docs with _n_words and _n_sentences (what the split at . ! ? gives, an empty tail included). Each text is split once:
    a generated row keeps the optimizer from working the counts out again in every expression above."""
    text = T.text("text")
    return docs.select("*", F.inline(F.array(F.struct(F.size(T.words(text)).alias("_n_words"), F.size(F.split(text, "[.!?]+")).alias("_n_sentences")))))


def readability(text: Column, n_words: Column, n_sentences: Column) -> Column:
    sentence = F.greatest(F.lit(0.0), 1 - F.abs(n_words / n_sentences - 17.5) / 17.5)
    word = F.greatest(F.lit(0.0), 1 - F.abs(F.try_divide(F.length(text), n_words) - 5) / 5)
    structure = 0.5 + F.when(F.contains(text, F.lit("\n")), 0.2).otherwise(0.0) + F.when(text.rlike(HEADERS), 0.2).otherwise(0.0) + F.when(text.rlike(LISTS), 0.1).otherwise(0.0)
    return F.when(n_words == 0, 0.0).otherwise(F.least(F.lit(1.0), sentence * 0.3 + word * 0.3 + structure * 0.4))


def completeness(text: Column, n: Column) -> Column:
    code = F.contains(text, F.lit("```")) | text.rlike("`[^`]+`")
    plus = F.when(n > 100, 0.2).otherwise(0.0) + F.when(n > 500, 0.1).otherwise(0.0) + F.when(text.rlike(HEADERS), 0.1).otherwise(0.0) + F.when(text.rlike(LISTS), 0.05).otherwise(0.0) + F.when(code, 0.1).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(clamp(0.5 + plus - hits(F.lower(text), INCOMPLETE) * 0.1))


def freshness(created_at: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, created_at)
    steps = F.when(days <= 7, 1.0).when(days <= 30, 0.9).when(days <= 90, 0.8).when(days <= 365, 0.6).when(days <= 730, 0.4).otherwise(0.2)
    return F.when(created_at.isNull(), 0.5).otherwise(steps)


def scores(docs: DataFrame, as_of: str, keep_counts: bool = False) -> DataFrame:
    """docs with the five scores and overall, and the counts of `counted` if these are to be kept. Needs text, source_type
    and created_at; domain counts if there is one."""
    text, kind = T.text("text"), F.col("source_type")
    domain = F.col("domain") if "domain" in docs.columns else None
    scored = counted(docs).withColumns({
        "relevance": relevance(text, kind),
        "authority": authority(kind, domain),
        "readability": readability(text, F.col("_n_words"), F.col("_n_sentences")),
        "completeness": completeness(text, F.col("_n_words")),
        "freshness": freshness(F.col("created_at"), F.to_date(F.lit(as_of))),
    })
    found = scored.withColumn("overall", F.expr("relevance * 0.3 + authority * 0.25 + readability * 0.2 + completeness * 0.15 + freshness * 0.1"))
    return found if keep_counts else found.drop("_n_words", "_n_sentences")


# The issues' texts, and those that keep a document out.
SHORT, FEW_WORDS, PLACEHOLDER, INCOMPLETE_TEXT = "Content too short", "Insufficient word count", "Contains placeholder content", "Content appears incomplete"
NO_PARAGRAPHS, UNKNOWN_SOURCE, NO_TIME = "Poor formatting (no paragraphs)", "Unknown source type", "No timestamp information"
BLOCKING = [PLACEHOLDER, SHORT, FEW_WORDS]


def issues(text: Column, source_type: Column, created_at: Column, n_words: Column | None = None) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(
        F.when(F.length(bare(text)) < 50, SHORT),
        F.when((F.size(T.words(text)) if n_words is None else n_words) < 10, FEW_WORDS),
        F.when(hits(low, PLACEHOLDERS) > 0, PLACEHOLDER),
        F.when(hits(low, UNFINISHED) > 0, INCOMPLETE_TEXT),
        F.when(~F.contains(text, F.lit("\n")) & (F.length(text) > 500), NO_PARAGRAPHS),
        F.when(source_type == "unknown", UNKNOWN_SOURCE),
        F.when(created_at.isNull(), NO_TIME),
    ))


def authority_category(source_type: Column) -> Column:
    return (
        F.when(source_type.isin("official_website", "documentation"), "high")
        .when(source_type.isin("github_repository", "chat_channel", "wikipedia"), "medium")
        .when(source_type.isin("blog_post", "forum", "social_media"), "low")
        .otherwise("unknown")
    )


def valid(text: Column, least: int = 50, share: float = 0.4) -> Column:
    """Long enough, and enough of it letters and digits."""
    alnum = F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))
    return (F.length(bare(text)) >= least) & (F.try_divide(alnum, F.length(text)) >= share)


def gate(docs: DataFrame, default: float = 0.4) -> DataFrame:
    """Why each document (with overall, issues, source_type, is_copy) is skipped, null if it is not."""
    threshold = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in THRESHOLDS.items()], F.lit(default))
    reason = F.when(F.col("is_copy"), "exact duplicate").when(F.col("overall") < threshold, "low quality").when(F.arrays_overlap("issues", F.array(*map(F.lit, BLOCKING))), "blocking issue")
    return docs.withColumn("skip_reason", reason)


# The advice's texts.
ADVICE = {
    "reject": "Consider rejecting - very low quality content", "review": "Flag for manual review - below quality threshold", "relevance": "Low relevance - consider content filtering",
    "completeness": "Content appears incomplete - verify source", "issues": "Quality issues detected: ", "copy": "Exact duplicate found - skip ingestion",
}


def recommendations() -> Column:
    """From overall, relevance, completeness, issues and is_copy."""
    return F.array_compact(F.array(
        F.when(F.col("overall") < 0.3, ADVICE["reject"]).when(F.col("overall") < 0.5, ADVICE["review"]),
        F.when(F.col("relevance") < 0.4, ADVICE["relevance"]),
        F.when(F.col("completeness") < 0.4, ADVICE["completeness"]),
        F.when(F.size("issues") > 0, F.concat(F.lit(ADVICE["issues"]), F.array_join("issues", ", "))),
        F.when(F.col("is_copy"), ADVICE["copy"]),
    ))


def store_scores(docs: DataFrame, as_of: str) -> DataFrame:
    """The metadata store's own formula: completeness by length, readability by mean word length."""
    text = T.text("text")
    n = F.size(T.words(text))
    mean = F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "\\s+", "")), n), F.lit(0.0))
    kinds = {"chat_channel": 0.8, "pdf_document": 0.9, "word_document": 0.8, "markdown_file": 0.7, "url_webpage": 0.6}
    scored = docs.withColumns({
        "completeness": F.when(F.length(text) > 1000, 0.9).when(F.length(text) > 500, 0.7).otherwise(0.5),
        "readability": F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - (mean - 5) / 10)),
        "authority": F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in kinds.items()], F.lit(0.5)),
        "freshness": F.coalesce(F.greatest(F.lit(0.1), 1 - F.datediff(F.to_date(F.lit(as_of)), "created_at") / 365), F.lit(0.5)),
    })
    return scored.withColumn("overall", F.expr("completeness * 0.25 + readability * 0.2 + authority * 0.25 + 0.7 * 0.15 + freshness * 0.15"))
