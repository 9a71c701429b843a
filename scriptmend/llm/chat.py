"""Chat formatting in budgeted windows, in DataFrame operations only.

Windows hold ``budget`` tokens. Each has room for the conversation's system turn (its first, where it takes half the
budget at most) and R tokens besides. With m the longest other turn, but R / 2 at most, prefix sums of turn tokens
lay the conversation on a grid of R - m tokens: the turns of up to m tokens that begin in one cell are a
window, and take less than R; a longer turn reaches beyond its cell and is a window of its own. A window
opens with the system turn, repeats the ``history`` turns before it as far as they fit into what is left, the nearest first, then has its own. So only a
window of a single turn that is itself too long passes the budget. The loss mask covers the assistant texts of a
window's own turns only, so that a repeated target is never learnt twice.

A turn is written ``<|turn|>role\\ntext<|end|>\\n``, a repeated one with ``<|again|>``. In roles and texts the
characters \\, < and [ become \\s, \\l and \\b (and a line end in a role \\n), so that no control string
survives inside a text, and each can be read back.

Defined results: a null text or role is empty; a null turn comes first; rows with equal turn are ordered by
role and text; repeated rows are turns of their own; an empty table gives an empty result; a text of any length is
one turn, never cut; a system turn of over half the budget, or after the first, is a turn like others; extra columns are
not read. All turns of a conversation meet where its digest is taken, which the digest of a sequence needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, AGAIN, END = "<|turn|>", "<|again|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    for plain, written in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for written, plain in (("\\n", "\n"), ("\\b", "["), ("\\l", "<"), ("\\s", "\\")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def n_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character that is not blank."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"))


def format_windows(turns: DataFrame, budget: int = 512, history: int = 2, loss_role: str = "assistant") -> DataFrame:
    """conv_id, window, formatted, loss (array of start and end, code points in ``formatted``), n_tokens."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("tokens", (n_tokens(F.col("text")) + 4).cast("long"))
    c, whole = F.col, Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(order))
    rows = rows.withColumn("first", F.min(F.when(c("role") == "system", F.struct("pos", "tokens"))).over(whole))
    retained = c("first.tokens") <= budget // 2
    rows = rows.withColumn("opening", F.coalesce(retained & (c("pos") == c("first.pos")), F.lit(False))).withColumn("room", budget - F.when(retained, c("first.tokens")).otherwise(0))
    rows = rows.withColumn("cost", F.when(c("opening"), 0).otherwise(c("tokens"))).withColumn("most", F.least(F.max("cost").over(whole), F.floor(c("room") / 2)))
    rows = rows.withColumn("cell", F.floor((F.sum("cost").over(upto) - c("cost")) / (c("room") - c("most")))).withColumn("alone", c("cost") > c("most"))
    rows = rows.withColumn("starts", ~F.struct("cell", "alone").eqNullSafe(F.lag(F.struct("cell", "alone")).over(order)))
    rows = rows.withColumn("own_window", F.sum(c("starts").cast("int")).over(upto) - 1).withColumn("last", F.sum(c("starts").cast("int")).over(whole) - 1)
    left = c("room") - F.sum("cost").over(Window.partitionBy("conv_id", "own_window"))
    before = [sum(F.lag("cost", j).over(order) for j in range(1, k + 1)) for k in range(1, history + 1)]
    fits = sum((F.coalesce((b <= left).cast("int"), F.lit(0)) for b in before), F.lit(0))
    rows = rows.withColumn("fits", F.when(c("starts"), fits).otherwise(0))
    later = F.filter(F.array(*(F.when(F.lead("fits", k).over(order) >= k, F.lead("own_window", k).over(order)) for k in range(1, history + 1))), lambda x: x.isNotNull())
    everywhere = F.when(c("last") > c("own_window"), F.sequence(c("own_window") + 1, c("last"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("later", later).withColumn("repeated", F.when(c("opening"), everywhere).otherwise(c("later")))
    placed = rows.withColumn("window", F.explode(F.concat(F.array("own_window"), "repeated"))).withColumn("own", F.col("window") == F.col("own_window"))
    placed = placed.withColumn("head", F.concat(F.when(F.col("own"), F.lit(TURN)).otherwise(F.lit(AGAIN)), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")))
    placed = placed.withColumn("body", escaped(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(END)))
    flow = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.sum(F.length("piece")).over(flow) - F.length("piece") + F.length("head"))
    target = F.when(F.col("own") & (F.col("role") == loss_role), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    parts = F.sort_array(F.collect_list(F.struct("pos", "piece", target.alias("target"), "tokens", "own")))
    windows = placed.groupBy("conv_id", "window").agg(parts.alias("parts"))
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p["target"]), lambda t: t.isNotNull()).alias("loss"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_tokens"),
    )


def read_back(windows: DataFrame, budget: int = 512) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows and n_over (windows of several own turns over the budget), all from ``formatted``, ``loss`` and ``n_tokens``."""
    pattern = F.lit(r"(?s)<\|(turn|again)\|>([^\n]*)\n(.*?)<\|end\|>\n")
    found = F.arrays_zip(*(F.regexp_extract_all("formatted", pattern, F.lit(k)).alias(n) for k, n in ((1, "kind"), (2, "role"), (3, "text"))))
    rows = windows.select("conv_id", "window", (F.col("n_tokens") > budget).alias("over"), F.length("formatted").cast("long").alias("chars"), F.filter(found, lambda t: t["kind"] == "turn").alias("turns"), F.transform("loss", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))).alias("targets"))
    rows = rows.withColumn("said", F.array_join(F.transform("turns", lambda t: F.concat(unescaped(t["role"]), F.lit("\n"), unescaped(t["text"]), F.lit("\n"))), "")).withColumn("learnt", F.array_join(F.transform("targets", unescaped), ""))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"), F.sum(F.size("turns")).cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("over") & (F.size("turns") > 1)).alias("n_over"))
    whole = whole.withColumn("learnt", F.array_join(F.transform("w", lambda x: x["learnt"]), ""))
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "n_windows", "n_over")


#: Added to the conversations by the query: control strings inside texts.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

#: DuckDB SQL for the query (budget 512, history 2).
ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) + 4 AS tokens,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c),
y AS (SELECT *, min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id) AS sp FROM t),
r AS (SELECT *, max(CASE WHEN pos = sp THEN tokens END) OVER (PARTITION BY conv_id) AS st FROM y),
k AS (SELECT *, coalesce(st <= 256 AND pos = sp, false) AS opening, 512 - CASE WHEN st <= 256 THEN st ELSE 0 END AS room FROM r),
f AS (SELECT *, CASE WHEN opening THEN 0 ELSE tokens END AS cost FROM k),
m AS (SELECT *, least(max(cost) OVER (PARTITION BY conv_id), room // 2) AS most, sum(cost) OVER (PARTITION BY conv_id ORDER BY pos) - cost AS begin FROM f),
g AS (SELECT *, 2 * (begin // (room - most)) + (cost > most)::INT AS cell FROM m),
b AS (SELECT *, coalesce(lag(cell) OVER (PARTITION BY conv_id ORDER BY pos) <> cell, true) AS starts FROM g),
w AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS win, sum(starts::INT) OVER (PARTITION BY conv_id) AS n_windows, lag(cost) OVER (PARTITION BY conv_id ORDER BY pos) AS l1, lag(cost, 2) OVER (PARTITION BY conv_id ORDER BY pos) AS l2 FROM b),
h AS (SELECT *, room - sum(cost) OVER (PARTITION BY conv_id, win) AS spare FROM w),
l AS (SELECT *, CASE WHEN starts THEN coalesce((l1 <= spare)::INT, 0) + coalesce((l1 + l2 <= spare)::INT, 0) ELSE 0 END AS fits FROM h),
x AS (SELECT *, CASE WHEN opening THEN n_windows - win
                     ELSE coalesce((lead(fits) OVER (PARTITION BY conv_id ORDER BY pos) >= 1)::INT, 0) + coalesce((lead(fits, 2) OVER (PARTITION BY conv_id ORDER BY pos) >= 2)::INT, 0) END AS again,
             length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + length(regexp_replace(role, '[^\n]', '', 'g')) AS chars FROM l)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + 17 + again * (chars + 18))::BIGINT AS formatted_chars, any_value(n_windows)::BIGINT AS n_windows, 0::BIGINT AS n_over
FROM x GROUP BY conv_id
"""
