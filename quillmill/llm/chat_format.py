"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is a list of parts (kind, text, ref, units): text parts are escaped and copied; image, audio and
document parts become ordered placeholders `<|kind:k|>`, k counting the attachments of a turn from 1, and are recorded
as attachments with the number of tokens their placeholder will expand to.

Template of a turn: <|im_start|>{role}\\n{body}<|im_end|>\\n. Inside roles and texts a backslash becomes two and `<|`
becomes `<\\|`, so a control string in a text is never one in the output; roles also hold line ends as backslash-n. Both
are undone by reading escapes from left to right.

Defined results: a null text or role is empty; a null content has no parts; unknown kinds are treated as text; turns
that tie are ordered by role and body; a null conv_id is a conversation of its own; an empty table gives an empty
result. A conversation becomes one string, so its length is bounded by what one row may hold; turns are formatted one
by one before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"
#: Tokens that a placeholder expands to, for each unit: image tiles, seconds of audio, document pages.
TOKENS_PER_UNIT = {"image": 196.0, "audio": 25.0, "document": 512.0}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # an odd run of backslashes before an n: its last one and the n stand for a line end
    return unescape(F.regexp_replace(role, "(?<!\\\\)((?:\\\\\\\\)*)\\\\n", "$1\n"))


def _is_media(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*TOKENS_PER_UNIT), F.lit(False))


def _media_tokens(part: Column) -> Column:
    per = F.coalesce(*[F.when(part["kind"] == k, F.lit(v)) for k, v in TOKENS_PER_UNIT.items()])
    return F.ceil(F.greatest(F.coalesce(part["units"], F.lit(1.0)), F.lit(0.0)) * per).cast("long")


def visit_parts(content: Column) -> tuple[Column, Column]:
    """The flattened body of a content column and its attachments (ordinal, kind, ref, tokens). A part's number counts
    the attachments before it, so the cost follows the square of a message's parts, which are few."""
    parts = F.coalesce(content, F.array().cast(PARTS))
    media = F.filter(parts, _is_media)
    attachments = F.transform(media, lambda p, i: F.struct((i + 1).cast("int").alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), _media_tokens(p).alias("tokens")))
    upto = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), _is_media))
    flat = F.transform(parts, lambda p, i: F.when(_is_media(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), upto(i).cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))))
    return F.array_join(flat, ""), attachments


def _running(sizes: Column, step: int = 128) -> Column:
    """Where each of these sizes begins if they lie end to end. Sums of blocks of `step` first, then within each block, so
    the cost stays near that of the sizes themselves for very long conversations."""
    held = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 - worked out once
    plus = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda x, y: x + y)
    block = lambda n, b: F.slice(n, b * step + 1, F.lit(step))
    numbers = lambda n: F.sequence(F.lit(0), F.floor((F.size(n) - 1) / step).cast("int"))
    sums = lambda n: F.transform(numbers(n), lambda b: plus(block(n, b)))
    bases = lambda n: held(sums(n), lambda s: F.transform(s, lambda _, b: F.struct(b.alias("b"), plus(F.slice(s, F.lit(1), b)).alias("base"))))
    inside = lambda n, x: held(block(n, x["b"]), lambda part: F.transform(part, lambda _, i: x["base"] + plus(F.slice(part, F.lit(1), i))))
    return held(sizes, lambda n: F.flatten(F.transform(bases(n), lambda x: inside(n, x))))


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages (conv_id, turn, role, content: PARTS) -> one row per conversation: conv_id, n_turns, formatted, the
    loss mask (for each turn of a loss role: turn index, offset in the turn's segment, global start, length), attachments
    with their turn index, expanded_tokens (of all attachments)."""
    body, attachments = visit_parts(F.col("content"))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = messages.select("conv_id", "turn", role.alias("role"), escape_role(role).alias("shown"), body.alias("body"), attachments.alias("attachments"))
    turns = turns.withColumn("head", F.length(F.lit(START)) + F.length("shown") + 1).withColumn("chars", F.col("head") + F.length("body") + F.length(F.lit(END)))
    segment = F.concat(F.lit(START), F.col("shown"), F.lit("\n"), F.col("body"), F.lit(END))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", segment.alias("segment"), "head", "chars", F.length("body").alias("body_chars"), "attachments")))
    conv = turns.groupBy("conv_id").agg(rows.alias("rows"))
    conv = conv.withColumn("starts", _running(F.transform("rows", lambda r: r["chars"].cast("long"))))
    marked = F.zip_with(F.sequence(F.lit(0), F.size("rows") - 1), F.col("rows"), lambda i, r: F.struct(i.alias("i"), r.alias("r")))
    mask = F.transform(F.filter(marked, lambda x: x["r"]["role"].isin(*loss_roles)), lambda x: F.struct(x["i"].alias("turn_index"), x["r"]["head"].alias("offset"), (F.get("starts", x["i"]) + x["r"]["head"]).alias("start"), x["r"]["body_chars"].alias("length")))
    files = F.flatten(F.transform(marked, lambda x: F.transform(x["r"]["attachments"], lambda a: F.struct(x["i"].alias("turn_index"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return conv.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("formatted"),
        mask.alias("loss_mask"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and masks hold: conv_id, turns (role, text), loss_text, formatted_chars. Placeholders
    of attachments stay in the texts as they are shown."""
    cut = F.slice(F.split("formatted", "<\\|im_start\\|>"), 2, 2**31 - 1)  # no text has the marker unescaped
    held = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), "loss_mask", cut.alias("segments"))
    role = lambda s: unescape_role(F.substring_index(s, "\n", 1))
    body = lambda s: s.substr(F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s) - F.length(F.substring_index(s, "\n", 1)) - 1 - len(END))
    turns = F.transform("segments", lambda s: F.struct(role(s).alias("role"), unescape(body(s)).alias("text")))
    masked = F.transform("loss_mask", lambda m: unescape(F.get("segments", m["turn_index"]).substr(m["offset"] - len(START) + 1, m["length"])))
    return held.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted_chars")


def text_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages with one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.array(part).cast(PARTS).alias("content"))
