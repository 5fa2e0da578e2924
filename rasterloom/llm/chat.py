"""Operator 9: chat formatting in budgeted windows.

Prefix sums of turn tokens (words and TURN_TOKENS for the marks) deal a conversation's turns into spans, never splitting
a turn. Each span becomes one training text of at most `budget` tokens: the leading system turn is retained, the last
`history` turns before the span are repeated if they fit in `history_budget` tokens, then come the span's own turns.
The loss mask covers the text of the span's own assistant turns; repeated ones are masked out, so each is learned once.

How spans keep the budget: what the system turn and the history leave is the room. Prefix sums cut a conversation into
cells of the room less its largest turn of up to an eighth. The turns that lie within a cell are a span. A turn that reaches over a cell's end goes with the
cell that it ends in if all that fits in the room, else with the cell that it begins in if there is room left, else it is
a span of its own. So a text exceeds the budget only if it is the system turn and one single turn, without history.

A turn is written `<turn>ROLE\\nTEXT</turn>\\n`. Inside roles and texts a backslash is doubled and `<` becomes
`\\l` (in roles a line feed becomes `\\n`), so no text can hold a turn mark, and unescaping gives it back.

Defined cases: null text or role is empty; turns go by (turn, role, md5 of the text), null turns first; rows of a null
conv_id are one conversation; repeated rows are turns of their own; a conversation without assistant turns has an
empty loss; other columns are not used. Spans are planned on slim rows with running sums over range partitions, and
texts are joined to the plan, so a conversation that holds most rows is spread over tasks. Only the digest of a
whole conversation, which read_back() makes, needs all its text in one row (Spark holds up to 2 GB there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import pin, repeated, row_key, running_sums, settled, table

OPEN, CLOSE = "<turn>", "</turn>\n"
BUDGET, HISTORY, HISTORY_BUDGET, TURN_TOKENS = 512, 2, 128, 4


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    """Escaped text holds no `<`, so that stands for a backslash until the other codes are read."""
    out = F.replace(text, F.lit("\\\\"), F.lit("<"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n")) if role else out
    return F.translate(F.replace(out, F.lit("\\l"), F.lit("\\")), "<\\", "\\<")


def plan_spans(turns: DataFrame, budget: int, history: int, history_budget: int) -> DataFrame:
    """Slim rows (conv, rank, before, tokens, role, h1, h2, span, system): which turn goes into which span."""
    spark = turns.sparkSession
    slim = turns.select("conv", "turn", "role", F.md5("text").alias("tie"), (F.size(F.split("text", r"\s+")) + TURN_TOKENS).cast("long").alias("tokens"), "h1", "h2")
    groups = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n"))
    groups = running_sums(spark, groups, "conv", ["turn", "role", "tie"], {"before": F.col("tokens") * F.col("n"), "rank": F.col("n")})
    rows = repeated(groups, "n", "nth").withColumn("before", F.col("before") + F.col("nth") * F.col("tokens")).withColumn("rank", F.col("rank") + F.col("nth") + 1)
    rows = pin(spark, rows.drop("nth", "tie", "turn"), "turns")
    system = F.max(F.when((F.col("rank") == 1) & (F.col("role") == "system"), F.struct("tokens", "h1", "h2"))).alias("system")
    small = F.max(F.when(F.col("tokens") * 8 <= budget - history_budget, F.col("tokens"))).alias("small")
    rows = rows.join(rows.groupBy("conv").agg(system, small), "conv")
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history_budget) - F.coalesce("system.tokens", F.lit(0)))
    rows = rows.withColumn("room", room).withColumn("width", F.expr("room - least(coalesce(small, 0), room div 8)"))
    rows = rows.withColumn("cell", F.expr("before div width")).withColumn("ends", F.expr("(before + tokens - 1) div width"))
    within, over = F.when(F.col("cell") == F.col("ends"), F.col("tokens")), F.when(F.col("cell") < F.col("ends"), F.col("tokens"))
    cells = rows.groupBy("conv", "room", F.col("ends").alias("cell")).agg(F.coalesce(F.sum(within), F.lit(0)).alias("whole"), F.coalesce(F.max(over), F.lit(0)).alias("front"))
    fits = F.col("front") + F.col("whole") <= F.col("room")
    cells = cells.withColumn("held", F.col("whole") + F.when(fits, F.col("front")).otherwise(0))
    rows = rows.join(cells.select("conv", F.col("cell").alias("ends"), "whole"), ["conv", "ends"])
    rows = rows.join(cells.select("conv", "cell", "held"), ["conv", "cell"], "left")
    ahead, behind = F.col("whole") + F.col("tokens") <= F.col("room"), F.col("held") + F.col("tokens") <= F.col("room")
    span = F.when((F.col("cell") == F.col("ends")) | ahead, F.col("ends") * 2).when(behind, F.col("cell") * 2).otherwise(F.col("ends") * 2 - 1)
    return rows.select("conv", "rank", "before", "tokens", "role", "h1", "h2", span.alias("span"), "system")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """One row a span: conv_id, span, formatted, loss_spans (start, length in code points), n_repeated, n_tokens."""
    spark, none = turns.sparkSession, F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    # marked, so that no text is taken for a null id
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("conv_id").cast("string")))
    rows = rows.select("*", conv.alias("conv"), *row_key(rows))
    planned = settled(spark, lambda: plan_spans(rows, budget, history, history_budget), "spans")
    spans = planned.groupBy("conv", "span").agg(
        F.min("rank").alias("from"), F.min("before").alias("at"), F.sum("tokens").alias("own"), F.first("system").alias("system")
    )
    spans = spans.filter(F.col("from") > 1)
    head = spans.filter(F.col("system").isNotNull()).select("conv", "span", F.lit(0).cast("long").alias("order"), "system.h1", "system.h2", F.col("system.tokens").alias("tokens"), F.lit(False).alias("mine"))
    room = F.least(F.lit(history_budget).cast("long"), F.lit(budget) - F.col("own") - F.coalesce("system.tokens", F.lit(0)))
    asked = spans.select("conv", "span", "at", room.alias("room"), F.col("system").isNotNull().alias("retained"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("from") - history), F.col("from") - 1)).alias("rank"))
    asked = asked.filter((F.col("rank") > 1) | ~F.col("retained")).drop("retained")
    again = asked.join(planned.drop("span", "system"), ["conv", "rank"]).filter(F.col("at") - F.col("before") <= F.col("room"))
    again = again.select("conv", "span", F.col("rank").alias("order"), "h1", "h2", "tokens", F.lit(False).alias("mine"))
    own = planned.select("conv", "span", F.col("rank").alias("order"), "h1", "h2", "tokens", F.lit(True).alias("mine"))
    pieces = own.unionByName(head).unionByName(again)
    texts = rows.dropDuplicates(["h1", "h2"]).select("h1", "h2", "conv_id", "role", "text")
    parts = pieces.join(texts, ["h1", "h2"])
    lead = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit("\n"))
    parts = parts.withColumn("lead", lead).withColumn("body", escape(F.col("text")))
    parts = parts.withColumn("written", F.concat("lead", "body", F.lit(CLOSE)))
    in_span = Window.partitionBy("conv", "span").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("written")).over(in_span), F.lit(0)) + F.length("lead"))
    target = F.when(F.col("mine") & (F.col("role") == "assistant"), F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length")))
    whole = parts.groupBy("conv", "span").agg(
        F.first("conv_id").alias("conv_id"), F.sum("tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("order", "written", "mine", target.alias("target")))).alias("parts"),
    )
    targets = F.filter(F.transform("parts", lambda p: p.target), lambda t: t.isNotNull())
    return whole.select(
        "conv_id", "span", F.array_join(F.transform("parts", lambda p: p.written), "").alias("formatted"),
        targets.alias("loss_spans"), F.size(F.filter("parts", lambda p: ~p.mine)).alias("n_repeated"), "n_tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Parse formatted windows: per conversation its turns and its learned text, as counts and digests."""
    def parsed(written: Column) -> Column:
        body = F.substr(written, F.lit(len(OPEN) + 1))
        cut = F.instr(body, F.lit("\n"))
        return F.concat(unescape(F.substr(body, F.lit(1), cut - 1), role=True), F.lit("\n"), unescape(F.substr(body, cut + 1)), F.lit("\n"))

    written = F.filter(F.split("formatted", CLOSE), lambda s: s != "")
    fresh = F.filter(written, lambda s, i: i >= F.col("n_repeated"))
    learned = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s.start + 1, s.length)))
    spans = windows.select(
        "conv_id", "span", F.size(fresh).alias("n"), F.array_join(F.transform(fresh, parsed), "").alias("turns"),
        F.array_join(learned, "").alias("loss"), F.length("formatted").alias("chars"),
    )
    whole = spans.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("loss")).alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("span", "turns", "loss"))).alias("spans"),
    )

    def digest(field: str) -> Column:
        return F.sha2(F.array_join(F.transform("spans", lambda s: s[field]), "").cast("binary"), 256)

    return whole.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), "loss_chars", digest("loss").alias("loss_sha256"), "formatted_chars")


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_windows(turns.unionByName(extra)))


ORACLES = {
    "op9_chat_windows": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        k AS (SELECT *, len(string_split_regex(text, '\s+')) + 4 AS tokens FROM t),
        b AS (
            SELECT *, row_number() OVER w AS rank, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
        i AS (
            SELECT conv_id AS c, coalesce(max(tokens) FILTER (rank = 1 AND role = 'system'), 0) AS sys, any_value(text) FILTER (rank = 1 AND role = 'system') AS sys_text,
                   coalesce(max(tokens) FILTER (tokens * 8 <= 384), 0) AS small FROM b GROUP BY conv_id),
        j AS (SELECT *, greatest(1, 384 - sys) AS room, greatest(1, 384 - sys) - least(small, greatest(1, 384 - sys) // 8) AS width FROM i),
        g AS (SELECT b.*, sys, sys_text, room, before // width AS cell, (before + tokens - 1) // width AS ends FROM b JOIN j ON b.conv_id IS NOT DISTINCT FROM j.c),
        e AS (SELECT conv_id AS c, ends AS e, room AS r, coalesce(sum(tokens) FILTER (cell = ends), 0) AS whole, coalesce(max(tokens) FILTER (cell < ends), 0) AS front FROM g GROUP BY ALL),
        f AS (SELECT *, whole + CASE WHEN front + whole <= r THEN front ELSE 0 END AS held FROM e),
        r AS (
            SELECT g.*, CASE WHEN cell = ends OR n.whole + tokens <= room THEN 2 * ends WHEN p.held + tokens <= room THEN 2 * cell ELSE 2 * ends - 1 END AS span
            FROM g JOIN f n ON g.conv_id IS NOT DISTINCT FROM n.c AND ends = n.e LEFT JOIN f p ON g.conv_id IS NOT DISTINCT FROM p.c AND cell = p.e),
        z AS (SELECT conv_id AS c, span AS s, min(rank) AS f, min(before) AS at, sum(tokens) AS own, any_value(sys) AS sys, any_value(sys_text) AS sys_text FROM r GROUP BY ALL HAVING min(rank) > 1),
        parts AS (
            SELECT conv_id, role, text FROM r
            UNION ALL SELECT c, 'system', sys_text FROM z WHERE sys > 0
            UNION ALL
            SELECT r.conv_id, r.role, r.text FROM r JOIN z ON r.conv_id IS NOT DISTINCT FROM z.c
            WHERE r.rank BETWEEN z.f - 2 AND z.f - 1 AND NOT (r.rank = 1 AND z.sys > 0) AND z.at - r.before <= least(128, 512 - z.own - z.sys)),
        chars AS (
            SELECT conv_id, sum(15 + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n'))
                + length(replace(replace(text, '\', '\\'), '<', '\l')))::BIGINT AS formatted_chars
            FROM parts GROUP BY conv_id),
        turns AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY rank) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
            FROM r GROUP BY conv_id)
        SELECT turns.*, formatted_chars FROM turns JOIN chars ON turns.conv_id IS NOT DISTINCT FROM chars.conv_id
    """,
}
