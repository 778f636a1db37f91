"""Source divergence audit: how far the term shares of a language's sources lie apart.

Terms are runs of letters (ASCII ones lower-cased, every character from U+0080 on as it is); a
language keeps the terms that at least ``LEAST_DOCS`` of its documents hold.  A share is an integer
price, 1 + floor(SCALE * (count + 1) / (N + V)), so it depends on a term only by its count in the
group, its level.  Two groups therefore need no term-by-term comparison: with one indicator column
per (group, level) and one row per term, the matrix times its own transpose says for every two
levels of every two groups how many terms have both (the joint table), and each of its cells is
priced once.

The matrix is cut into blocks of terms of like frequency: a block ends at ``ROWS`` terms or
``COLUMNS`` indicator columns, products are taken in tiles of ``COLUMNS`` squared, and a task keeps
only sums per two sources.  Level 0 has no column: what it adds comes from the number of terms at
each level (the margins) and from one cell per two groups,

    sum f(p, q) = sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]
                + sum over terms of the first [f(p, q0) - f(p0, q0)]
                + sum over terms of the second [f(p0, q) - f(p0, q0)] + V f(p0, q0).

All numbers are integers: products of indicators stay below 2**24 (exact in single precision),
prices below 2**30, gaps and their sums below 2**63.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidex.session import cut_lineage

LEAST_DOCS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
ROWS, COLUMNS = 8192, 512
HELD = 600_000  # distinct (group, term) entries that a task counts before it passes them on
SLICE = 4 << 20  # bytes of a text that are split into terms at once
#: Bytes of a term keep their value (A-Z in lower case); all others become a space.
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def slices(data: bytes):
    """Parts of a translated text that end between terms."""
    at = 0
    while at < len(data):
        end = len(data) if at + SLICE >= len(data) else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs, times: occurrences per group, summed over tasks."""
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    some = docs.select(*group_columns(docs), text.alias("text"))
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("times", pa.int64())])

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (docs, times) in held.items():
                terms = list(times)
                for at in range(0, len(terms), 20_000):
                    some = terms[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                            pa.array(some, pa.binary()).cast(pa.string()),
                            pa.array([docs[t] for t in some], pa.int64()), pa.array([times[t] for t in some], pa.int64()),
                        ],
                        schema=arrow,
                    )
            held.clear()

        entries = 0
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for lang, source, text in zip(langs, sources, texts):
                docs, times = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(times), set()
                for part in slices(text.as_py().translate(LETTERS)):
                    words = part.split()
                    times.update(words)
                    seen.update(words)
                docs.update(seen)
                entries += len(times) - before
                if entries > HELD:
                    yield from flush()
                    entries = 0
        yield from flush()

    found = some.mapInArrow(run, "lang string, source string, term string, docs long, times long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))


def group_columns(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, times (> 0), in_lang, leads: one row per kept term and group that has it.

    ``leads`` marks one row of each kept term."""
    of_term = Window.partitionBy("lang", "term")
    return (
        term_counts(docs)
        .withColumn("lang_docs", F.sum("docs").over(of_term))
        .withColumn("in_lang", F.sum("times").over(of_term))
        .withColumn("leads", F.row_number().over(of_term.orderBy("source")) == 1)
        .where(F.col("lang_docs") >= least_docs)
        .select("lang", "term", "source", "times", "in_lang", "leads")
    )


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for any count."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of two prices."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n, v, p0, lang_n: every occurring group with its totals and its price of count 0."""
    groups = docs.select(*group_columns(docs)).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("times").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("times").alias("lang_n"), F.sum(F.col("leads").cast("long")).alias("v"))
    zero = F.lit(0).cast("long")
    joined = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    full = joined.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "v", "lang_n")))
    return full.withColumn("p0", price(zero, F.col("n"), F.col("v")))


class Block:
    """Terms of one language as an indicator matrix over (source, price)."""

    def __init__(self, lang: str):
        self.lang, self.columns, self.zero = lang, {}, {}
        self.at, self.row, self.rows = [], [], 0

    def term(self, entries) -> None:
        """entries: (source, price, price of count 0) of the groups that hold the term."""
        for source, p, p0 in entries:
            self.at.append(self.columns.setdefault((source, p), len(self.columns)))
            self.row.append(self.rows)
            self.zero[source] = p0
        self.rows += 1

    def full(self) -> bool:
        return self.rows >= ROWS or len(self.columns) >= COLUMNS

    def sums(self):
        """(source, other, priced joint tables of the block), tile by tile."""
        order = sorted(self.columns)
        place = np.empty(len(order), np.int64)
        place[[self.columns[c] for c in order]] = np.arange(len(order))
        names = sorted(self.zero)
        number = {s: i for i, s in enumerate(names)}
        source = np.array([number[s] for s, _ in order])
        p = np.array([x for _, x in order], np.int64)
        p0 = np.array([self.zero[s] for s, _ in order], np.int64)
        row, col = np.array(self.row), place[self.at]
        tiles = []
        for low in range(0, len(order), COLUMNS):
            inside = (col >= low) & (col < low + COLUMNS)
            x = np.zeros((self.rows, min(COLUMNS, len(order) - low)), np.float32)
            x[row[inside], col[inside] - low] = 1
            tiles.append((low, x))
        for low, x in tiles:
            for other, y in tiles:
                joint = x.T @ y
                i, j = np.nonzero(joint)
                n = joint[i, j].astype(np.int64)
                i, j = i + low, j + other
                a, b, a0, b0 = p[i], p[j], p0[i], p0[j]
                worth = n * (gaps(a, b) - gaps(a, b0) - gaps(a0, b) + gaps(a0, b0))
                first, second = source[low], source[other]
                total = np.zeros((source[i].max() - first + 1, source[j].max() - second + 1), np.int64) if len(i) else np.zeros((0, 0), np.int64)
                np.add.at(total, (source[i] - first, source[j] - second), worth)
                for s, t in zip(*np.nonzero(total)):
                    yield names[first + s], names[second + t], int(total[s, t])


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def joint_worth(priced: DataFrame) -> DataFrame:
    """lang, source, item, value: what the terms of both groups add, from the block products.

    ``priced``: lang, term, source, in_lang, p, p0.  The rows of a term meet by hash; within a task
    they come by frequency, so that a block of rare terms has few columns and many rows."""
    rows = priced.repartition("lang", "term").sortWithinPartitions("lang", "in_lang", "term")
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(batches):
        total: dict[tuple[str, str, str], int] = {}
        block = term = None
        entries: list = []

        def flush():
            made = [(*k, v) for k, v in total.items()]
            total.clear()
            for at in range(0, len(made), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made[at : at + 50_000]), arrow)], schema=arrow)

        def close():
            for source, other, value in block.sums():
                if source != other:
                    key = (block.lang, source, other)
                    total[key] = total.get(key, 0) + value
                    if len(total) >= 1_000_000:
                        yield from flush()

        for batch in batches:
            for lang, word, source, p, p0 in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, word) != term:
                    if entries:
                        block.term(entries)
                        entries = []
                    if block and (block.lang != lang or block.full()):
                        yield from close()
                        block = None
                    block, term = block or Block(lang), (lang, word)
                entries.append((source, p, p0))
        if entries:
            block.term(entries)
            yield from close()
        yield from flush()

    made = rows.select("lang", "term", "source", "p", "p0").mapInArrow(run, "lang string, source string, item string, value long")
    return made


def pair_values(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """lang, source, item, value of every two groups of a language."""
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    base = groups.join(others, "lang").where(apart).select(
        "lang", "source", "item", F.coalesce(F.col("v") * gap(p0, q0), F.lit(0)).alias("value")
    )
    levels = priced.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    margins = levels.join(others, "lang").where(apart).groupBy("lang", "source", "item").agg(
        F.sum(F.col("n") * (gap(p, q0) - gap(p0, q0))).alias("forth"),
        F.sum(F.col("n") * (gap(q0, p) - gap(q0, p0))).alias("back"),
    )
    parts = (
        base.unionAll(joint_worth(priced))
        .unionAll(margins.select("lang", "source", "item", "forth"))
        .unionAll(margins.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "back"))
    )
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a group uses more than its language."""
    q = price(F.col("in_lang"), F.col("lang_n"), F.col("v"))
    raised = priced.withColumn("q", q).where("p > q")
    return raised.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has a row for every other source of the
    language, part ``term`` the ``term_ranks`` terms whose share is raised most.

    Null text, lang and source count as ''.  Repeated rows are documents of their own.  A language
    without kept terms has pairs of value 0, a group without terms all pairs; an empty table gives
    no rows.  Only text, lang and source of ``docs`` are read, so other columns may have any name."""
    kept = cut_lineage(kept_terms(docs, least_docs), "kept-terms")
    groups = cut_lineage(group_table(docs, kept), "groups")
    totals = groups.select("lang", "source", "n", "v", "lang_n", "p0")
    priced = kept.join(totals, ["lang", "source"]).withColumn("p", price(F.col("times"), F.col("n"), F.col("v")))
    ranked = []
    for part, found in (("pair", pair_values(groups, priced)), ("term", term_values(groups, priced))):
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        rows = found.withColumn("rank", F.row_number().over(order))
        if part == "term":
            rows = rows.where(F.col("rank") <= term_ranks)
        ranked.append(rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank"))
    return ranked[0].unionAll(ranked[1])


ORACLE = r"""
with docs as (
  select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source
  from documents),
words as (
  select r, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as word from docs)),
vocabulary as (select lang, term, count(*) as in_lang from words group by lang, term having count(distinct r) >= 3),
counts as (
  select w.lang, w.source, w.term, count(*) as c from words w join vocabulary v on v.lang = w.lang and v.term = w.term
  group by w.lang, w.source, w.term),
sizes as (select lang, count(*) as v, sum(in_lang) as lang_n from vocabulary group by lang),
groups as (
  select g.lang, g.source, coalesce(s.v, 0) as v, coalesce(s.lang_n, 0) as lang_n, coalesce(t.n, 0) as n
  from (select distinct lang, source from docs) g left join sizes s on s.lang = g.lang
  left join (select lang, source, sum(c) as n from counts group by lang, source) t on t.lang = g.lang and t.source = g.source),
prices as (
  select g.lang, g.source, x.term, x.in_lang, coalesce(c.c, 0) as c, g.v, g.lang_n,
         1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (g.n + g.v)::hugeint as p
  from groups g join vocabulary x on x.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = x.term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from prices a join prices b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by a.lang, a.source, b.source),
all_pairs as (
  select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
shares as (
  select lang, source, term, p, 1 + (1000000000::hugeint * (in_lang + 1)) // (lang_n + v)::hugeint as q from prices where c > 0),
found as (
  select lang, source, 'pair' as part, item, value from all_pairs
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from shares where p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 200
"""
