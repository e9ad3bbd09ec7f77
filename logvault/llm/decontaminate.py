"""Operator 7: benchmark decontamination by template canonicalisation.

Texts become templates: a run of numbers or number words, a unit after a number
and a run of names (capitalised words inside a sentence) are replaced by the
typed placeholders 0, 2 and 1, everything else is lower-cased words without
punctuation. So "Boston" and "New York", "120" and "one hundred", "120 km" and
"120km" give the same template. Windows of eight template tokens are hashed and
joined with those of the benchmark. Items are also entered with the first words
of their sentences as names, since a document may quote them after other words,
and windows of the plain lower-cased words are joined beside the templates, so a
verbatim item matches whatever its case and line breaks.

Matches of a document with an item are collected by their offset; offsets that
differ by ``DRIFT`` tokens at most are summed. On them the slots must be
consistent: a value of the item stands for one value of the document wherever it
occurs. A document is contaminated by an item if the consistent windows cover at
least ``MIN_SHARE`` of the item or ``MIN_TOKENS`` tokens.

DataFrame functions only. The documents are read twice: once to hash windows
(only matching (document, position) rows leave the scan), once to write the slot
values of the candidates, each tokenised once. Rows that meet the benchmark are
reduced to distinct (item position, offset) before they are gathered, so a line
repeated in a text costs what its windows cost.

Defined cases: null and empty texts match nothing; items of 5 to 7 tokens are
one window of their length, shorter ones match nothing; template windows with
fewer than half literal words are no evidence (tables of numbers), unless the
plain words are equal; repeated rows give one
result for each (doc_id, item_id); a null doc_id or item_id is a value like any
other; equal items are reported each. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.llm.common import materialise, read_table, small_side

WINDOW, MIN_WINDOW = 8, 5
MIN_SHARE, MIN_TOKENS = 0.6, 20
DRIFT = 4

# Unit names that follow a number, and English number words.
UNITS = ("percent", "km", "m", "cm", "mm", "miles", "mile", "feet", "ft", "inches", "inch", "kg", "g", "mg", "lb", "lbs", "pounds",
         "tons", "l", "ml", "liters", "litres", "hours", "hour", "h", "minutes", "minute", "min", "seconds", "second", "s",
         "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "usd", "euros", "eur", "cents", "kmh",
         "mph", "degrees")
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
                "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
#: Template forms: the document's own, the item's with first words as names, the plain words.
TEMPLATE, FIRST_NAMES, PLAIN = 0, 1, 2


#: Words that need a second look; all others are literals or names.
_SPECIAL = (*NUMBER_WORDS, *UNITS, "and", ".")


def _spaced(text: Column) -> Column:
    """Words apart by one space, a ``.`` token at each sentence end, units apart from their numbers."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("%"), F.lit(" percent "))
    t = F.regexp_replace(F.regexp_replace(t, r"([0-9])[.,](?=[0-9])", "$1"), r"([0-9])(?=\p{L})", "$1 ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}.!?:]+", " ")
    return F.trim(F.regexp_replace(t, r"(?: ?[.!?:])+ ?", " . "))


def _typed(first_names: bool) -> Column:
    """The template token of each token of ``low``; runs are not yet joined."""
    digit = lambda x: (x >= "0") & (x < ":")
    number = lambda x: F.coalesce(digit(x) | x.isin(*NUMBER_WORDS), F.lit(False))

    def one(x, i):
        before, after = F.get("low", i - 1), F.get("low", i + 1)
        special = (F.when(x.isin(*NUMBER_WORDS), "0").when((x == "and") & F.coalesce(before.isin(*NUMBER_WORDS) & after.isin(*NUMBER_WORDS), F.lit(False)), "0")
                   .when(x.isin(*UNITS) & number(before), "2"))
        name = F.get("raw", i) != x
        if not first_names:
            name = name & (F.coalesce(before, F.lit(".")) != ".")
        return F.when(digit(x), "0").otherwise(F.coalesce(F.when(x.isin(*_SPECIAL), special), F.when(name, "1"), x))

    return F.transform("low", one)


def _stays(x: Column, i: Column) -> Column:
    """False for sentence ends and for all but the first of a run of numbers or names."""
    return ~x.isin("", ".", "0", "1") | x.isin("0", "1") & F.coalesce(F.get("typed", i - 1) != x, F.lit(True))


def _starts() -> Column:
    """Places of the tokens of ``typed`` that stay."""
    return F.filter(F.transform("typed", lambda x, i: F.when(_stays(x, i), i)), lambda i: i.isNotNull())


def tokenised(df: DataFrame, text: Column, first_names: bool = False) -> DataFrame:
    """``df`` with ``raw``, ``low``, ``words`` (plain), ``typed`` and ``template``. Each array is a column of its own, as lambdas look into it."""
    df = df.withColumn("spaced", _spaced(text)).withColumn("lower", F.lower("spaced"))
    df = df.withColumn("raw", F.split("spaced", " ")).withColumn("low", F.split("lower", " "))
    df = df.withColumn("words", F.filter("low", lambda x: ~x.isin("", "."))).drop("spaced", "lower")
    return df.withColumn("typed", _typed(first_names)).withColumn("template", F.filter("typed", _stays))


def with_values(df: DataFrame) -> DataFrame:
    """``df`` of ``tokenised`` with ``vals``: the words that stand at the places of ``template``, those of a run joined."""
    df = df.withColumn("at", _starts())
    end = lambda k: F.coalesce(F.get("at", k + 1), F.size("low"))
    run = lambda i, k: F.filter(F.slice("low", i + 1, end(k) - i), lambda x: x != ".")
    return df.withColumn("vals", F.transform("at", lambda i, k: F.array_join(run(i, k), " ")))


def is_slot(token: Column) -> Column:
    return token.isin("0", "1", "2")


def _windows(df: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """``keep`` columns with (pos, hash) of each window of ``size`` of the ``tokens``.

    Windows double: those of 2 from two of 1, of 4 from two of 2, and so on;
    other sizes are put together from these. Every level is a column of its own,
    so each array is computed once.
    """
    def joined(df: DataFrame, name: str, a: str, b: str, shift: int) -> DataFrame:
        """Windows ``a`` with the windows ``b`` that start ``shift`` tokens later."""
        df = df.withColumn("n", F.greatest(F.lit(0), F.least(F.size(a), F.size(b) - shift)))
        return df.withColumn(name, F.zip_with(F.slice(a, F.lit(1), F.col("n")), F.slice(b, F.lit(shift + 1), F.col("n")),
                                              lambda x, y: F.xxhash64(x, y)))

    df = df.withColumn("w1", F.transform("tokens", lambda x: F.xxhash64(x)))
    width, out, have = 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, have = f"w{width}", width
            else:
                df = joined(df, f"o{width}", out, f"w{width}", have)
                out, have = f"o{width}", have + width
        if width * 2 > size:
            # the outer form: the plain one infers a filter on the array that is pushed below and repeats every level
            return df.select(*keep, F.posexplode_outer(out).alias("pos", "hash"))
        df = joined(df, f"w{width * 2}", f"w{width}", f"w{width}", width)
        width *= 2


def item_windows(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame | None, list[int]]:
    """The benchmark's template forms (row, kind, item_id, n_tokens, size, tokens, vals), their windows and the window sizes in use."""
    src = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("item_text")).withColumn("row", F.monotonically_increasing_id())
    form = lambda df, kind, tokens, vals: df.select("row", F.lit(kind).alias("kind"), "item_id", tokens.alias("tokens"), vals.alias("vals"))
    forms = None
    for kind in (TEMPLATE, FIRST_NAMES):
        one = form(with_values(tokenised(src, F.col("item_text"), kind == FIRST_NAMES)), kind, F.col("template"), F.col("vals"))
        forms = one if forms is None else forms.unionByName(one)
    forms = forms.unionByName(form(tokenised(src, F.col("item_text")), PLAIN, F.col("words"), F.col("words")))
    forms = materialise(forms.withColumn("n_tokens", F.size("tokens")).withColumn("size", F.least("n_tokens", F.lit(WINDOW))), "benchmark-forms")
    forms = forms.filter(F.col("size") >= MIN_WINDOW)
    sizes = sorted(r["size"] for r in forms.select("size").distinct().collect())  # four values at most
    rows = None
    keep = ["row", "kind", "n_tokens", "size", "tokens"]
    for s in sizes:
        w = _windows(forms.filter(F.col("size") == s).select(*keep), s, keep)
        literal = F.size(F.filter(F.slice("tokens", F.col("pos") + 1, F.lit(s)), lambda x: ~is_slot(x)))
        w = w.filter("hash is not null").filter((F.col("kind") == PLAIN) | (literal * 2 >= s))
        w = w.select("row", "kind", "n_tokens", "size", F.col("pos").alias("item_pos"), "hash", (F.col("kind") == PLAIN).alias("plain"))
        rows = w if rows is None else rows.unionByName(w)
    return forms, rows, sizes


def _document_windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, form, pos, hash) of the windows of each document: 0 template, 1 plain, 2 both where they are equal."""
    t = tokenised(docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text"), F.col("text"))
    view = lambda form, tokens: F.struct(F.lit(form).alias("form"), F.col(tokens).alias("tokens"))
    views = F.when(F.col("template") == F.col("words"), F.array(view(2, "words"))).otherwise(F.array(view(0, "template"), view(1, "words")))
    both = t.select("doc_id", "th", F.explode_outer(views).alias("view"))
    return _windows(both.select("doc_id", "th", "view.form", "view.tokens"), size, ["doc_id", "th", "form"])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, th (text hash), item_id, n_tokens, covered, n_slots, n_changed of each contaminated pair."""
    forms, rows, sizes = item_windows(benchmark, item_id, item_text)
    out_schema = ["doc_id", "th", "item_id", "n_tokens", "covered", "n_slots", "n_changed"]
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if rows is None:
        no_item = F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item_id")
        return d.limit(0).select("doc_id", F.xxhash64("text").alias("th"), no_item,
                                 *[F.lit(0).cast("int").alias(c) for c in out_schema[3:]])
    side = small_side(materialise(rows, "benchmark-windows"), 64)
    hits = None
    for s in sizes:
        h = (_document_windows(d, s).join(side.filter(F.col("size") == s), "hash").filter(F.col("form").isin(2, F.col("plain").cast("int")))
             .select("doc_id", "th", "row", "kind", "n_tokens", "size", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift")))
        hits = h if hits is None else hits.unionByName(h)
    # offsets within DRIFT of each other share one of two overlapping bands
    band = lambda at: F.floor((F.col("shift") + at) / (2 * DRIFT))
    banded = hits.distinct().withColumn("band", F.explode(F.array(band(0) * 2, band(DRIFT) * 2 + 1)))
    per_band = banded.groupBy("doc_id", "th", "row", "kind", "band").agg(
        F.collect_list(F.struct("item_pos", "shift")).alias("hits"), F.first("size").alias("size"), F.first("n_tokens").alias("n_tokens"))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["item_pos"], h["item_pos"] + F.col("size") - 1))))
    found = materialise(per_band.withColumn("covered", F.size(places)).filter(
        (F.col("covered") >= min_share * F.col("n_tokens")) | (F.col("covered") >= min_tokens)), "leak-candidates")
    # second look, at the template candidates only: each document is tokenised once, its slot values written
    asked = materialise(found.filter(F.col("kind") != PLAIN).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).distinct(), "leak-documents")
    texts = d.withColumn("th", F.xxhash64("text")).join(
        small_side(asked, 64), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th")), "left_semi")
    vals = with_values(tokenised(texts, F.col("text"))).select(F.col("doc_id").alias("v_id"), F.col("th").alias("v_th"), F.col("vals").alias("doc_vals"))
    vals = materialise(vals, "leak-values").dropDuplicates(["v_id", "v_th"])
    items = forms.select("row", "kind", "item_id", "tokens", F.col("vals").alias("item_vals"))
    both = (found.filter(F.col("kind") != PLAIN).join(vals, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("th") == F.col("v_th")))
            .join(items, ["row", "kind"]))
    slots = lambda h: F.filter(F.sequence(h["item_pos"], h["item_pos"] + F.col("size") - 1), lambda p: is_slot(F.get("tokens", p)))
    pair = lambda p, h: F.struct(F.get("item_vals", p).alias("was"), F.get("doc_vals", p + h["shift"]).alias("now"))
    pairs = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(slots(h), lambda p: pair(p, h)))))
    both = both.select("doc_id", "th", "item_id", "row", "n_tokens", "covered", pairs.alias("pairs"))
    told = (both.withColumn("n_slots", F.size("pairs")).withColumn("agrees", F.size("pairs") == F.size(F.array_distinct("pairs.was")))
            .withColumn("n_changed", F.size(F.filter("pairs", lambda p: ~p["was"].eqNullSafe(p["now"])))).drop("pairs").withColumn("verbatim", F.lit(False)))
    zero = F.lit(0).cast("int")
    words = (found.filter(F.col("kind") == PLAIN).join(items.select("row", "kind", "item_id"), ["row", "kind"])
             .select("doc_id", "th", "item_id", "row", "n_tokens", "covered", zero.alias("n_slots"), F.lit(True).alias("agrees"),
                     zero.alias("n_changed"), F.lit(True).alias("verbatim")))
    # equal words are evidence unless the template covers more of the item and its slots disagree
    view = F.struct(F.col("covered"), (-F.col("n_changed")).alias("kept"), "n_slots", "item_id", "n_tokens")
    share = F.col("covered") / F.col("n_tokens")
    best = told.unionByName(words).groupBy("doc_id", "th", "row").agg(
        F.max(F.when(F.col("agrees") & ~F.col("verbatim"), view)).alias("template"), F.max(F.when(F.col("verbatim"), view)).alias("plain"),
        F.max(F.when(F.col("verbatim"), share)).alias("plain_share"), F.max(F.when(~F.col("agrees"), share)).alias("against"))
    plain = F.when(F.col("against").isNull() | (F.col("plain_share") >= F.col("against")), F.col("plain"))
    best = best.select("doc_id", "th", F.greatest("template", plain).alias("b")).filter("b is not null")
    return best.select("doc_id", "th", "b.item_id", "b.n_tokens", "b.covered", "b.n_slots", (-F.col("b.kept")).alias("n_changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    leaks = materialise(contaminated(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("th").alias("leak_th"))
                        .distinct(), "leaks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("leak_id")) & (F.xxhash64("row.text") == F.col("leak_th"))
    return rows.join(small_side(leaks, 32), same, "left_anti").select("row.*")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated (doc_id, item_id) pairs of all documents and the whole benchmark."""
    out = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_tokens", "covered", "n_slots", "n_changed").distinct()


QUERIES = {"op7_template_decontamination": op7_template_decontamination}
ORACLE_SQL: dict[str, str] = {}
