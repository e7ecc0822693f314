"""Benchmark decontamination on templates, in DataFrame functions only.

Words are canonicalised: numbers become <num> (12.5 and 1,250 are one number each),
units after a number <unit>, words with a capital <name>.  Windows of ``width``
canonical words of the documents are hash-joined with those of the benchmark items,
so a question with other numbers or names still matches.  Folded windows, of
lower-cased words without <name>, are joined as well, so a copy in another case
matches; a window counts as found by either form.  Aligned placeholders are then
compared: a re-parameterised copy maps each value of the item to one value of the
document, and pairs whose mapping is not consistent are dropped.

An item of fewer than ``width`` words, ``shortest`` at least, is one window of its
whole length.  Windows with fewer than ``literal`` words that are no placeholders
are not used, since they would match tables and headings; of an item whose windows
all have fewer, those with the most are, if these are two or more.

The benchmark side is broadcast only if its windows, which are counted and take
some fifty bytes each, are at most ``broadcast_rows``; beyond that the join shuffles.

Defined results: null or empty texts, items without usable windows and empty
tables give no rows; a null doc_id or item_id gives no row; rows that share a
doc_id count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Units that may follow a number; fixed values.
UNITS = ("mm cm m km in ft yd mi mg g kg lb oz t ml cl l s sec min h hr hrs ms ns us hz khz mhz ghz w kw mw v a k c f "
         "meter meters metre metres kilometers grams kilograms pounds ounces liters litres seconds minutes hours days "
         "weeks months years miles feet inches dollars euros pounds percent degrees usd eur gbp kb mb gb tb").split()


def words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), "")


def joined_numbers(text: Column) -> Column:
    """The text with points and commas inside numbers taken out."""
    return F.regexp_replace(text, "([0-9])[.,]([0-9])", "$1$2")


def _is_number(w: Column) -> Column:
    return (w >= "0") & (w < ":")


def folded(w: Column) -> Column:
    """The words in lower case, numbers and units as placeholders."""
    units = F.array(*(F.lit(u) for u in sorted(set(UNITS))))

    def one(x, i):
        before = F.get(w, i - 1)
        return (F.when(_is_number(x), "<num>")
                .when((i > 0) & _is_number(before) & F.array_contains(units, F.lower(x)), "<unit>")
                .otherwise(F.lower(x)))

    return F.transform(w, one)


def canonical(w: Column, low: Column) -> Column:
    """The words with typed placeholders, from the words and their ``folded`` form."""
    return F.zip_with(w, low, lambda x, y: F.when(x == y, x).when(y.startswith("<"), y).otherwise("<name>"))


def _forms(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w, f, c): words, folded and canonical; ``f`` stands alone, so that it is computed once."""
    split = table.select(F.col(key).cast("long").alias("key"), words(joined_numbers(F.col(text))).alias("w")).where("key is not null")
    return split.select("key", "w", folded(F.col("w")).alias("f")).select("key", "w", "f", canonical(F.col("w"), F.col("f")).alias("c"))


def _windows(h: Column, width: int) -> Column:
    """Hash of the window at each start; a text shorter than the width has none."""
    start = F.sequence(F.lit(0), F.size(h) - width)
    return F.when(F.size(h) >= width, F.transform(start, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))))


def _side(table: DataFrame, key: str, text: str, widths: list[int]) -> DataFrame:
    """(key, at, hash) of every window of each width, canonical and, where that differs, folded."""
    hashed = _forms(table, key, text).select("key", *(F.transform(x, lambda v: F.xxhash64(v)).alias(x) for x in "cf"))
    both = hashed.select("key", *(_windows(F.col(x), n).alias(f"{x}{n}") for n in widths for x in "cf"))
    every = F.array(*(F.struct(F.col(f"c{n}").alias("c"), F.col(f"f{n}").alias("f")) for n in widths))
    each = both.select("key", F.explode(every).alias("v")).where("v.c is not null") if len(widths) > 1 else both.select(
        "key", F.struct(F.col(f"c{widths[0]}").alias("c"), F.col(f"f{widths[0]}").alias("f")).alias("v"))
    c, f = F.col("v.c"), F.col("v.f")
    # a column of its own, as rows would keep ``v`` else, and a text cost the square of its length; outer, as Spark would filter by its size else and compute it twice
    each = (each.select("key", F.size(c).alias("n"), F.concat(c, F.zip_with(c, f, lambda a, b: F.when(a != b, b))).alias("every"))
            .select("key", "n", F.posexplode_outer("every").alias("at", "hash")))
    return each.where("hash is not null").select("key", (F.col("at") % F.col("n")).alias("at"), "hash")


def _items(benchmark: DataFrame, width: int, literal: int, shortest: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, at, hash, width, total) of the usable windows of items.

    Where capitals leave an item no usable canonical window, as in a text of
    capitals only, its folded windows are used.
    """
    base = _forms(benchmark, item_col, text_col).withColumn("n", F.size("c")).where(F.col("n") >= shortest).withColumn("width", F.least("n", F.lit(width)))
    windows = base.select(F.col("key").alias("item_id"), "width", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("width")),
        lambda i: F.struct(i.alias("at"), F.slice("c", i + 1, F.col("width")).alias("c"), F.slice("f", i + 1, F.col("width")).alias("f")))).alias("v"))
    windows = windows.select("item_id", "width", "v.*").distinct()
    for x in "cf":
        windows = windows.withColumn(f"{x}_solid", F.size(F.filter(x, lambda v: ~v.isin("<num>", "<unit>", "<name>"))))
        # as ``_side`` hashes a window of this width
        by_width = [F.when(F.col("width") == n, F.xxhash64(*(F.xxhash64(F.get(x, F.lit(k))) for k in range(n)))) for n in range(shortest, width + 1)]
        windows = windows.withColumn(f"{x}_hash", F.coalesce(*by_width))
    most = windows.groupBy("item_id").agg(F.max("c_solid").alias("c_most"), F.max("f_solid").alias("f_most"))
    windows = windows.join(most, "item_id")
    for x in "cf":
        enough = F.least(F.lit(literal), f"{x}_most")
        windows = windows.withColumn(f"{x}_hash", F.when((F.col(f"{x}_solid") >= enough) & (enough >= 2), F.col(f"{x}_hash")))
    total = windows.groupBy("item_id").agg(F.countDistinct(F.when(F.col("c_hash").isNotNull(), F.col("at"))).alias("typed"),
                                           F.countDistinct(F.when(F.col("f_hash").isNotNull(), F.col("at"))).alias("plain"))
    usable = windows.join(total, "item_id").where("c_hash is not null or typed = 0 and f_hash is not null")
    return (usable.select("item_id", "at", "width", F.explode(F.array_distinct(F.array("c_hash", "f_hash"))).alias("hash"),
                          F.when(F.col("typed") > 0, F.col("typed")).otherwise(F.col("plain")).alias("total"))
            .where("hash is not null"))


def _slots(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, value) of the placeholders."""
    value = F.transform("w", lambda x, i: F.when(F.get("c", i).isin("<num>", "<unit>", "<name>"), F.lower(x)))
    return _forms(table, key, text).select("key", F.posexplode(value).alias("pos", "value")).where("value is not null")


def _runs(hits: DataFrame, least: int) -> DataFrame:
    """(doc_id, item_id, part, shift, first, n): at least ``least`` windows of an item, found one after another."""
    at = ["doc_id", "item_id", "shift"]
    spots = hits.select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("shift"), "q").distinct()
    order = Window.partitionBy(*at).orderBy("q")
    runs = (spots.withColumn("run", F.col("q") - F.row_number().over(order)).groupBy(*at, "run")
            .agg(F.min("q").alias("first"), F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= least))
    return runs.select("doc_id", "item_id", F.concat_ws(":", "shift", "first").alias("part"), "shift", "first", "n")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, literal: int = 5, coverage: float = 0.5,
          consistency: float = 0.8, broadcast_rows: int = 2_000_000, run_words: int = 13, shortest: int = 3,
          id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, consistency, changed) of leaked items.

    A pair is a leak by ``coverage`` or by one run of at least ``run_words``
    aligned words in a row, either with consistent placeholders; those of a pair
    that only a run makes a leak are told of its longest such run.

    ``coverage`` is the share of the item's usable windows found in the
    document, ``consistency`` the share of aligned placeholders that follow one
    mapping, ``changed`` the share whose value differs from the item's.
    """
    items = C.written(_items(benchmark, width, literal, shortest, item_col, text_col))
    small = items.count() <= broadcast_rows
    # at most one width for each word that an item is short of the full one
    widths = sorted({r.width for r in items.select("width").distinct().collect()} | {width})
    found = _side(docs, id_col, text_col, widths).select(F.col("key").alias("doc_id"), F.col("at").alias("p"), "hash")
    side = items.select("item_id", F.col("at").alias("q"), "hash", "total", "width")
    hits = found.join(F.broadcast(side) if small else side, "hash").select("doc_id", "item_id", "p", "q", "total", "width")
    hits = C.written(hits)
    pair = ["doc_id", "item_id"]
    counted = (hits.groupBy(*pair).agg(F.countDistinct("q").alias("n_windows"), F.max("total").alias("total"))
               .withColumn("coverage", F.col("n_windows") / F.col("total")))
    whole = counted.where(F.col("coverage") >= coverage).selectExpr(*pair, "'' as part", "null as shift", "null as first", "null as n")
    pairs = C.written(whole.unionByName(_runs(hits, max(1, run_words - width + 1))).join(counted, pair))
    aligned = (hits.join(pairs.where("part = ''").select(*pair), pair, "left_semi")
               .select(*pair, F.lit("").alias("part"), (F.col("p") - F.col("q")).alias("shift"), "q",
                       F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("k"))
               .select(*pair, "part", "shift", (F.col("q") + F.col("k")).alias("pos")).distinct())
    aligned = aligned.unionByName(pairs.where("part <> ''").select(*pair, "part", "shift", F.explode(
        F.sequence(F.col("first"), F.col("first") + F.col("n") + (width - 2))).alias("pos")))
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    theirs = _slots(some.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text").distinct()
    ours = _slots(benchmark, item_col, text_col)
    both = (aligned.join(ours.select(F.col("key").alias("item_id"), "pos", F.col("value").alias("item_value")), ["item_id", "pos"])
            .withColumn("pos", F.col("pos") + F.col("shift"))
            .join(theirs.select(F.col("key").alias("doc_id"), "pos", F.col("value").alias("doc_value")), ["doc_id", "pos"]))
    times = both.groupBy(*pair, "part", "shift", "item_value", "doc_value").agg(F.count(F.lit(1)).alias("n"))
    mapped = times.groupBy(*pair, "part", "shift", "item_value").agg(
        F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.when(F.col("item_value") != F.col("doc_value"), F.col("n")).otherwise(0)).alias("other"))
    checked = mapped.groupBy(*pair, "part").agg(
        (F.sum("most") / F.sum("n")).alias("consistency"), (F.sum("other") / F.sum("n")).alias("changed"))
    out = (pairs.join(checked, [*pair, "part"], "left")
           .withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).withColumn("changed", F.coalesce("changed", F.lit(0.0)))
           .where(F.col("consistency") >= consistency))
    # the pair as a whole comes first, then its longest run
    best = F.max_by(F.struct("consistency", "changed"), F.struct(F.col("part") == "", "n", "consistency", "part"))
    return (out.groupBy(*pair, "n_windows", "coverage").agg(best.alias("best"))
            .select(*pair, "n_windows", "coverage", "best.consistency", "best.changed"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The documents that hold no benchmark item; those with a null id stay."""
    leaked = leaks(docs, benchmark, id_col=id_col, **parameters).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs[id_col].cast("long") == leaked.leaked_id, "left_anti").select(*docs.columns)
