"""Chat formatting in budgeted windows, in DataFrame operations only.

Prefix sums of turn tokens cut a conversation into spans that end at turns.  BUDGET
less SYSTEM (kept free for the system turn) and HISTORY is the room of a span's own
turns.  A turn of more than a quarter of the room is a span of its own; the others
between two such turns are cut where their prefix sum passes a multiple of three
quarters of the room, so a span never has more than the room.  Each span is
formatted as one window: the leading system turn again, the last turns of the span
before as history (up to HISTORY tokens, and only what the budget leaves), then its
own turns.  A window exceeds BUDGET only if the system turn and one turn alone do, or
if the system turn has more than SYSTEM + HISTORY tokens.  Only the texts of a
window's own assistant turns are under its loss mask, so repeated turns never count
twice.

Tokens are the matches of TOKEN, counted in the JVM (ASCII letters and digits in
threes, every other sign, line feed and run of spaces), plus MARKS for the turn's marks; or
the column that the caller names, for instance counts of a tokenizer.

Spans and history also end at every multiple of BLOCK turn numbers, so a long
conversation is many tasks; texts are shuffled once.  A window's span number is
2**32 times its block plus its place there.  The digests below need a conversation's
whole text in one row, as SHA-256 cannot be merged; the windows do not.

Turns are written between start and end marks.  Control strings inside roles and
texts get an escape character after their first character; the escape character
itself and, in roles, line feeds are written as escape sequences.  Undoing these
gives back the exact text.

Defined results: null role and null text are empty; rows of one turn number are
ordered by role and text, repeated rows stay; a null conv_id is a conversation of
its own; a null turn comes first; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read

#: Tokens of a window, of its history, and those kept free for the system turn; tokens of a turn's marks; turn numbers in a block.
BUDGET, HISTORY, SYSTEM, MARKS, BLOCK = 2048, 256, 512, 4, 4096
TOKEN = r"[A-Za-z]{1,3}|\p{N}{1,3}|[\x09-\x0D]|[^\x20\x09-\x0DA-Za-z\p{N}]|\x20{2,}"
START, END, ESCAPE = "<|im_start|>", "<|im_end|>\n", "␛"
#: Control strings of common chat templates, split after the first character.
CONTROL = r"(<|\[)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit(ESCAPE), F.lit(ESCAPE + "e")), CONTROL, f"$1{ESCAPE}x$2")


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit(ESCAPE + "n"))


def unescape(x: Column) -> Column:
    for mark, plain in (("n", "\n"), ("x", ""), ("e", ESCAPE)):
        x = F.replace(x, F.lit(ESCAPE + mark), F.lit(plain))
    return x


#: First turns of conversations of several blocks that may be sent to every executor, in bytes.
BROADCAST_HEADS = 16 << 20


def _heads(rows: DataFrame) -> DataFrame | None:
    """__conv, head: the first turn of every conversation of several blocks; None if there are none."""
    several = rows.groupBy("conv_id").agg(F.min("block").alias("least"), F.max("block").alias("most")).filter("least < most")
    several = materialise(several.select(F.col("conv_id").alias("__conv"), "least"))
    if several.isEmpty():
        return None
    first = rows.join(several, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("least")))
    heads = materialise(first.groupBy("__conv").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("head")))
    size = heads.agg(F.sum(F.octet_length("head.text") + F.octet_length("head.role") + 64)).first()[0]
    return F.broadcast(heads) if size <= BROADCAST_HEADS else heads


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, tokens: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per window: conv_id, span, n_tokens, formatted, n_context (repeated turns in front), loss (start, length in code points)."""
    room = budget - system - history
    if room < 8:
        raise ValueError("the budget leaves no room for turns")
    counted = F.regexp_count("text", F.lit(TOKEN)) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *([] if tokens is None else [tokens]))
    rows = rows.select("conv_id", "turn", "role", "text", (counted + MARKS).cast("long").alias("tokens"), F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**30))).alias("block"))
    heads = _heads(rows)
    turn = F.struct("turn", "role", "text", "tokens")
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = F.col("tokens") * 4 > room
    rows = rows.withColumns(
        {
            "at": F.row_number().over(order),
            "n_wide": F.sum(wide.cast("long")).over(so_far),
            "n_narrow": F.sum(F.when(wide, 0).otherwise(F.col("tokens"))).over(so_far),
            "ends": F.sum("tokens").over(so_far),
            "first": F.first(F.when(F.col("role") == "system", turn)).over(so_far),
        }
    )
    major = 2 * F.col("n_wide") - wide.cast("long")
    minor = F.when(wide, 0).otherwise(F.floor((F.col("n_narrow") - 1) / (room - room // 4)))
    own = F.struct("at", "role", "text", "tokens", "ends")
    spans = rows.groupBy("conv_id", "block", major.alias("major"), minor.alias("minor")).agg(F.sort_array(F.collect_list(own)).alias("own"), F.sum("tokens").alias("own_tokens"), F.first("first").alias("head"))
    line = Window.partitionBy("conv_id", "block").orderBy("major", "minor")
    spans = spans.withColumns({"n": F.row_number().over(line), "before": F.lag("own").over(line)})
    begins = F.lit(True)
    if heads is not None:  # in later blocks the first turn is not the conversation's
        spans = spans.withColumnRenamed("head", "here").join(heads, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
        begins = F.col("__conv").isNull() | (F.col("here") == F.col("head"))
        spans = spans.withColumn("head", F.when(F.col("__conv").isNull(), F.col("here")).when(F.col("head.role") == "system", F.col("head")))
        begins = F.coalesce(begins, F.lit(False))
    spans = spans.withColumn("begins", begins)
    has_head = F.col("head").isNotNull()
    plain = "array<struct<kind:int,role:string,text:string,tokens:bigint>>"
    short = lambda kind, ts: F.transform(ts, lambda t: F.struct(F.lit(kind).alias("kind"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens")))
    first = F.when(has_head & ~(F.col("begins") & (F.col("n") == 1)), short(0, F.array("head"))).otherwise(F.array().cast(plain))
    last = F.element_at("before", -1)["ends"]
    left = F.least(F.lit(history), F.lit(budget) - F.coalesce(F.col("head.tokens"), F.lit(0)) - F.col("own_tokens"))
    recent = F.filter("before", lambda t: (last - t["ends"] + t["tokens"] <= left) & ~(F.col("begins") & has_head & (t["at"] == 1)))
    all_turns = F.concat(first, short(1, F.coalesce(recent, F.array().cast(spans.schema["own"].dataType))), short(2, F.col("own")))
    spans = spans.select("conv_id", (F.col("block") * 2**32 + F.col("n") - 1).alias("span"), all_turns.alias("turns"))
    n_context = F.size(F.filter("turns", lambda t: t["kind"] < 2))
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    spans = spans.select("conv_id", "span", "turns", n_context.alias("n_context"), n_tokens.alias("n_tokens"))
    written = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("front"), escape(t["text"]).alias("body")))
    spans = spans.select("conv_id", "span", "n_tokens", "n_context", written.alias("written"))
    ends = F.transform("written", lambda t: F.length(t["front"]) + F.length(t["body"]) + len(END))
    spans = spans.withColumn("lengths", ends)
    starts = F.transform(
        "written",
        lambda t, i: F.struct(
            (F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(t["front"])).alias("start"),
            F.length(t["body"]).alias("length"),
            ((t["role"] == "assistant") & (i >= F.col("n_context"))).alias("counts"),
        ),
    )
    loss = F.transform(F.filter(starts, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    text = F.array_join(F.transform("written", lambda t: F.concat(t["front"], t["body"], F.lit(END))), "")
    return spans.select("conv_id", "span", "n_tokens", text.alias("formatted"), "n_context", loss.alias("loss"))


def read_turns(windows: DataFrame) -> DataFrame:
    """Parse formatted windows: conv_id, span, turns (role, text) of each window's own span, and its unescaped loss text."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    own = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(START) + 1, 2**30)
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "span", F.transform(own, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    parts = read_turns(windows).select(
        "conv_id",
        F.struct(
            "span",
            F.size("turns").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            "loss_text",
            "chars",
        ).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    text = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    total = lambda field: F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p[field])
    whole = whole.select("conv_id", total("n").alias("n_turns"), text("turns").alias("turns"), text("loss_text").alias("loss"), total("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Fixed value: what both turns of conversation -1 say.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    rows = turns.select("conv_id", "turn", "role", "text")
    extra = turns.sparkSession.range(2).select(
        F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return rows.unionByName(extra)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(format_windows(with_probe(read(spark, sf_dir, "conversations"))))


_ESC = r"regexp_replace(replace({x}, chr(9243), chr(9243) || 'e'), '" + CONTROL + r"', '\1' || chr(9243) || 'x\2', 'g')"
_ROOM = BUDGET - SYSTEM - HISTORY
ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), sized AS (
  SELECT *, coalesce(turn // {BLOCK}, -1) AS block, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS BIGINT) + {MARKS} AS tokens,
    length('{START}') + length(replace({_ESC.format(x='role')}, chr(10), chr(9243) || 'n')) + 1
      + length({_ESC.format(x='text')}) + length('{END.strip()}') + 1 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n_conv
  FROM rows_
), summed AS (
  SELECT *, sum(tokens) OVER w AS ends, sum(CASE WHEN 4 * tokens > {_ROOM} THEN 0 ELSE tokens END) OVER w AS narrow,
    sum(CASE WHEN 4 * tokens > {_ROOM} THEN 1 ELSE 0 END) OVER w AS wide
  FROM sized WINDOW w AS (PARTITION BY conv_id, block ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), spanned AS (
  SELECT *, CASE WHEN 4 * tokens > {_ROOM} THEN 2 * wide - 1 ELSE 2 * wide END AS major,
    CASE WHEN 4 * tokens > {_ROOM} THEN 0 ELSE CAST(floor((narrow - 1) / {_ROOM - _ROOM // 4}.0) AS BIGINT) END AS minor FROM summed
), heads AS (SELECT conv_id, tokens AS h_tokens, chars AS h_chars FROM spanned WHERE n_conv = 1 AND role = 'system'),
spans AS (
  SELECT conv_id, block, major, minor, sum(tokens) AS own, sum(chars) AS own_chars, max(ends) AS last_ FROM spanned GROUP BY ALL
), chained AS (
  SELECT *, lead(own) OVER (PARTITION BY conv_id, block ORDER BY major, minor) AS next_own, row_number() OVER (PARTITION BY conv_id ORDER BY block, major, minor) AS n FROM spans
), history AS (
  SELECT s.conv_id, sum(s.chars) AS chars FROM spanned s JOIN chained p USING (conv_id, block, major, minor) LEFT JOIN heads h USING (conv_id)
  WHERE p.next_own IS NOT NULL AND p.last_ - s.ends + s.tokens <= least({HISTORY}, {BUDGET} - coalesce(h.h_tokens, 0) - p.next_own)
    AND NOT (s.role = 'system' AND s.n_conv = 1) GROUP BY s.conv_id
), sizes AS (
  SELECT c.conv_id, sum(c.own_chars) + sum(CASE WHEN n > 1 THEN coalesce(h.h_chars, 0) ELSE 0 END) AS chars
  FROM chained c LEFT JOIN heads h USING (conv_id) GROUP BY c.conv_id
), texts AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM rows_ GROUP BY conv_id
)
SELECT t.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(z.chars + coalesce(h.chars, 0) AS BIGINT) AS formatted_chars
FROM texts t JOIN sizes z ON t.conv_id = z.conv_id LEFT JOIN history h ON t.conv_id = h.conv_id
"""
