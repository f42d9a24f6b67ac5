"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts and benchmark items are cut into words. Numbers, names (capitalised words inside a sentence, but not words in capitals
throughout, as texts can be shouted) and units after a number become typed placeholders, all else is lower-cased, so that a
question with other numbers or names in it has the template of the original. A capitalised word that begins a sentence may be
a name or not: texts are looked up with it as a name, and items are indexed both with it as a name and with it in small letters.
Windows of ``WINDOW`` template words (for shorter items: the whole item) are hash-joined with those of the benchmark; windows of placeholders alone
are not looked up. Each match lies
on a diagonal, the distance between the places in document and item; on a diagonal the slots must be filled consistently:
one value of the item stands for one value of the document. Windows that fill a slot otherwise than most of the diagonal are
put aside, so that a stray slot next to a passage does not hide it. A document is contaminated by an item if the consistent
windows of a diagonal cover at least ``LITERAL`` words that are no placeholders, or the whole item with its own values in
all slots. The first word of an item is indexed as at the start of a sentence and as inside one.

Items with fewer than ``LITERAL`` words that are no placeholders (and so all items of fewer words) are searched word by word as
they stand, in small letters, without placeholders, and count only whole: their template would say too little.

The benchmark's windows are broadcast only while there are at most ``BROADCAST_WINDOWS`` of them, which is counted; beyond
that the join is a shuffle. Windows of the corpus are made and joined in one pass, only matches move.

Cases: null and empty texts are clean; an empty benchmark leaves all clean; items without a word are ignored; a null doc_id is a document like any other; rows that repeat id and text get the same result each; null item
ids are ignored; extra columns stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.storage import Scratch

WINDOW = 13
LITERAL = 5
BROADCAST_WINDOWS = 200_000
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
UNITS = tuple(
    "kg g mg lb lbs oz ton tons tonne tonnes m km cm mm mile miles inch inches foot feet ft yard yards l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours h day days week weeks month months year years dollar dollars euro euros pound pounds cent cents percent kmh mph degree degrees watt watts volt volts joule joules newton newtons hz khz mhz gb mb kb".split()
)
#: A word, with the sign before it if it begins a sentence.
_WORD = r"(?:^[^\p{L}\p{N}]*|[.!?:\n][^\p{L}\p{N}]*)?(?:\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}'’]*)"
#: Before a capitalised word that begins a sentence.
_MARK = "^"
_KEYS = ["__id", "__th"]


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))


def words(text: Column) -> Column:
    """The words of a text; the first word of a sentence keeps the signs before it."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))


def bare(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+", "")


def template(raw: Column) -> Column:
    """Placeholder or lower-case form of each word of ``raw`` (a lambda variable, else it is made anew for every word).

    Capitalised words that begin a sentence are marked: ``first_template`` and ``second_template`` differ in these.
    """

    def one(x: Column, i: Column) -> Column:
        head = F.substring(x, 1, 1)
        digit = head.between("0", "9")
        low = F.lower(x)
        return (
            F.when(digit, F.lit(NUMBER))
            .when(low == x, F.when((i > 0) & low.isin(*UNITS) & F.element_at(raw, F.greatest(i, F.lit(1))).rlike(r"\p{N}$"), F.lit(UNIT)).when(F.lower(head) != F.upper(head), x).otherwise(_first(x)))
            .when(F.lower(head) != head, F.when(F.upper(x) == x, low).otherwise(F.lit(NAME)))
            .otherwise(_first(x))
        )

    def _first(x: Column) -> Column:
        """Words that begin a sentence, and numbers in other digits."""
        plain = bare(x)
        low = F.lower(plain)
        return F.when(plain.rlike(r"^\p{N}"), F.lit(NUMBER)).when((low != plain) & (F.upper(plain) != plain), F.concat(F.lit(_MARK), low)).otherwise(low)

    return F.transform(raw, one)


def first_template(marked: Column) -> Column:
    """Words that begin a sentence are literals."""
    return F.transform(marked, lambda y: F.when(y.startswith(_MARK), F.substring(y, 2, 1 << 30)).otherwise(y))


def second_template(marked: Column) -> Column:
    """Capitalised words that begin a sentence are names."""
    return F.transform(marked, lambda y: F.when(y.startswith(_MARK), F.lit(NAME)).otherwise(y))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once for each row."""
    return F.transform(F.array(value), use)[0]


def _places(n: Column, k: int) -> Column:
    """First places, from 1, of the windows of ``k`` of ``n`` words."""
    return F.when(n >= k, F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


FIRST, SECOND, PLAIN = "first", "second", "plain"


def window_keys(text: Column, form: str, sizes: list[int]) -> Column:
    """(at, k, w): place, size and hash of every window of each size.

    The words of ``form`` FIRST are those of the first template, of SECOND those of the second, of PLAIN the words as they stand in
    small letters.
    """

    def of_size(h: Column, k: int) -> Column:
        n, seed = F.size(h), F.lit(-k if form == PLAIN else k)
        places = F.when(n >= k, F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda s: F.struct((s - 1).alias("at"), F.lit(k).alias("k"), F.xxhash64(F.slice(h, s, k), seed).alias("w")))

    def of(h: Column) -> Column:
        parts = [of_size(h, k) for k in sizes]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    hashes = lambda words: F.transform(words, lambda y: F.xxhash64(y))
    if form == PLAIN:
        return _bound(_bound(words(text), lambda raw: F.transform(raw, lambda x: F.xxhash64(F.lower(bare(x))))), of)
    own = first_template if form == FIRST else second_template
    return _bound(_bound(_bound(words(text), template), lambda m: hashes(own(m))), of)


def _forms(itext: Column) -> Column:
    """An item begun inside a sentence and as a sentence, and in capitals and small letters throughout, which show no names."""
    begun = F.regexp_replace(itext, r"^[^\p{L}\p{N}]+", "")
    inside = F.concat(F.upper(F.substring(begun, 1, 1)), F.substring(begun, 2, 1 << 30))
    start = F.concat(F.lit(". "), begun)
    return F.array(inside, start, F.upper(start), F.lower(start))


def _literal(marked: Column) -> Column:
    """How many words of a marked template are no placeholders, where words that begin a sentence are literals."""
    return F.size(F.filter(marked, lambda y: ~y.isin(NUMBER, NAME, UNIT)))


def _items(benchmark: DataFrame, item_col: str, text_col: str, window: int, literal: int) -> DataFrame:
    """(item, itext, n, k, plain): the items that are searched; k is their window, ``plain`` says that they stand as they are."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("itext")).where("item is not null").distinct()
    sized = items.withColumns({"n": F.size(words(F.col("itext"))), "__said": _bound(_bound(words(F.col("itext")), template), _literal)})
    return sized.where("n > 0").select("item", "itext", "n", F.least("n", F.lit(window)).alias("k"), (F.col("__said") < literal).alias("plain"))


def _keys(items: DataFrame, sizes: list[int], plain_sizes: list[int]) -> DataFrame:
    """(item, iat, k, w): the windows of the benchmark, in both templates of every form of an item, or plain."""
    forms = items.where("not plain").select("item", F.col("k").alias("own"), F.explode(_forms(F.col("itext"))).alias("itext"))
    marked = forms.withColumn("marked", _bound(words(F.col("itext")), template))
    parts = []
    if sizes:
        for form in (FIRST, SECOND):
            own = marked.withColumn("x", F.explode(window_keys(F.col("itext"), form, sizes))).where("x.k = own")
            parts.append(own.where(_literal(F.slice("marked", F.col("x.at") + 1, F.col("own"))) > 0))
    if plain_sizes:
        plain = items.where("plain").withColumnRenamed("k", "own")
        parts.append(plain.withColumn("x", F.explode(window_keys(F.col("itext"), PLAIN, plain_sizes))).where("x.k = own"))
    out = [x.select("item", F.col("x.at").alias("iat"), "x.k", "x.w") for x in parts]
    if not out:
        return items.select("item", F.lit(0).alias("iat"), "k", F.lit(0).cast("long").alias("w")).where("false")
    return reduce(DataFrame.union, out).distinct()


def contaminated_pairs(df: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, literal: int) -> DataFrame:
    """(__id, __th, item, windows): documents that hold an item, and in how many windows."""
    items = scratch.write(_items(benchmark, item_col, item_text_col, window, literal))
    found_sizes = items.select("k", "plain").distinct().collect()  # at most two for each size up to the window's
    sizes, plain_sizes = (sorted(r["k"] for r in found_sizes if r["plain"] == p) for p in (False, True))
    keys = scratch.write(_keys(items, sizes, plain_sizes))
    count = keys.count()
    distinct = keys.select("k", "w").distinct()
    docs = df.select(_id(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).withColumn("__th", F.xxhash64("__text"))
    asked = [window_keys(F.col("__text"), form, own) for form, own in ((SECOND, sizes or [window]), (PLAIN, plain_sizes)) if own]
    mine = docs.select(*_KEYS, F.explode(F.concat(*asked) if len(asked) > 1 else asked[0]).alias("x")).select(*_KEYS, "x.at", "x.k", "x.w")
    near = scratch.write(mine.join(F.broadcast(distinct) if count <= BROADCAST_WINDOWS else distinct, ["k", "w"], "left_semi").distinct())
    hits = near.join(keys, ["k", "w"]).select(*_KEYS, "item", "k", "at", (F.col("at") - F.col("iat")).alias("diagonal"))
    found = scratch.write(hits.groupBy(*_KEYS, "item", "diagonal", "k").agg(F.sort_array(F.collect_set("at")).alias("ats")))
    some = docs.join(found.select(*_KEYS).distinct(), _KEYS, "left_semi").distinct()
    raw = lambda c: F.transform(words(F.col(c)), bare)
    # written, as are the steps below: as expressions they would be made anew for every word of the lambdas that use them
    texts = scratch.write(some.select(*_KEYS, raw("__text").alias("raw"), _bound(_bound(words(F.col("__text")), template), second_template).alias("words")))
    originals = scratch.write(items.select("item", "plain", raw("itext").alias("iraw")))
    slots = found.join(texts, _KEYS).join(originals, "item")
    place = lambda a, p: F.element_at(a, p + 1)
    covered = lambda ats: F.array_distinct(F.flatten(F.transform(ats, lambda s: F.sequence(s, s + F.col("k") - 1))))
    is_slot = lambda p: place("words", p).isin(NUMBER, NAME, UNIT)
    filled = F.transform(F.filter(covered(F.col("ats")), is_slot), lambda p: F.struct(p.alias("p"), place(F.col("iraw"), p - F.col("diagonal")).alias("a"), place(F.col("raw"), p).alias("b")))
    slots = scratch.write(slots.select(*_KEYS, "item", "diagonal", "k", "ats", "plain", F.size("iraw").alias("n"), filled.alias("filled")))
    # what each value of the item stands for most often (on ties: for itself); windows with another value in it do not count
    votes = lambda x: F.transform(F.filter("filled", lambda q: q["a"] == x), lambda q: q["b"])
    ranked = lambda x, bs: F.array_max(F.transform(F.array_distinct(bs), lambda y: F.struct(F.size(F.filter(bs, lambda z: z == y)).alias("n"), (y == x).alias("same"), y.alias("b"))))
    meant = F.transform(F.array_distinct(F.transform("filled", lambda q: q["a"])), lambda x: F.struct(x.alias("a"), _bound(votes(x), lambda bs: ranked(x, bs))["b"].alias("b")))
    slots = scratch.write(slots.withColumn("meant", meant))
    odd = F.transform(F.filter("filled", lambda q: ~F.array_contains("meant", F.struct(q["a"].alias("a"), q["b"].alias("b")))), lambda q: q["p"])
    good = _bound(odd, lambda out: F.filter("ats", lambda s: ~F.exists(out, lambda p: (p >= s) & (p < s + F.col("k")))))
    slots = scratch.write(slots.withColumn("good", good).drop("meant"))
    kept = covered(F.col("good"))
    literal_words = F.size(F.array_except(kept, F.transform("filled", lambda q: q["p"])))
    whole = (F.size(kept) == F.col("n")) & ~F.exists("filled", lambda q: F.lower(q["a"]) != F.lower(q["b"]))
    held = slots.where((F.size("good") > 0) & (whole | (~F.col("plain") & (literal_words >= literal))))
    return held.groupBy(*_KEYS, "item").agg(F.sum(F.size("good")).cast("long").alias("windows"))


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, literal: int = LITERAL
) -> DataFrame:
    """(doc_id, contaminated, n_windows, items) of each row; items are the sorted ids of what was found."""
    scratch = Scratch(df.sparkSession, "decontaminate")
    pairs = contaminated_pairs(df, benchmark, scratch, id_col, text_col, item_col, item_text_col, window, literal)
    found = scratch.write(pairs.groupBy(*_KEYS).agg(F.sum("windows").alias("n_windows"), F.sort_array(F.collect_list("item")).alias("items")))
    scratch.keep(found)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), _id(id_col).alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__th"))
    out = rows.join(found, _KEYS, "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def keep_clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, unchanged, that hold no item of the benchmark."""
    scratch = Scratch(df.sparkSession, "decontaminate")
    settings = {"item_col": "item_id", "item_text_col": "text", "window": WINDOW, "literal": LITERAL} | options
    found = scratch.write(contaminated_pairs(df, benchmark, scratch, id_col, text_col, **settings).select(*_KEYS).distinct())
    scratch.keep(found)
    return df.join(found, (_id(id_col) == F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__th")), "left_anti")
