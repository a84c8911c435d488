"""Fuzzy line dedup by MinHash, with DataFrame functions only.

Lines are compared after lower-casing and with runs of white space as one blank. Their features are character shingles:
the ``WIDTH`` characters from every place on, or the whole line where it is shorter, hashed. Signatures are ``MINIMA``
minima of one hash, each taken under another exclusive-or, and three of them are a band; any two of the ``BANDS`` bands
share one minimum at most. Lines of likeness 0.8 meet with probability 0.99 (sets of 5 shingles) to 0.999, those of 0.85
with 0.9998, and lines of common words only, of likeness 0.03, once in 2,600 pairs. Lines that meet and agree in
``AGREED`` minima, as all but one in ten thousand of likeness 0.8 do, are verified by the exact Jaccard likeness of their
shingle sets, links make components by distributed union-find, and of each component the first line (least doc_id, then
line number) is kept.

Equal lines are one class from the start. Shingles are hashed and reduced to minima in the task that reads the line; what
is shuffled is one signature a line. In a band, members are first held against the band's first line; then only lines in
different components whose bitmaps of shingles don't rule out a link are compared, in bands of many near copies by their differences from a centre
(``differences.py``), so that a group of near copies costs its size and not its square.

Defined cases: null or empty texts and empty tables have no lines; blank lines are kept and belong to no class; rules of
``WIDTH`` or more equal signs have the same shingle whatever their length; repeated rows repeat their lines, of which one
is kept; rows without doc_id come last in order, and of equal lines with equal places one is kept; other columns than
doc_id and text are not read, whatever their names. Lines are told apart by 128 bits of hashes, their links by 64 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import differences
from .components import components
from .differences import open_lists, renamed, verified
from .shared import dropped, staged

BANDS, MINIMA, PERCENT, WIDTH = 14, 20, 80, 9
#: Minima in which two lines agree if they are compared.
AGREED = 9
#: 64-bit words of the bitmap by which pairs that can't link are told, a power of two.
WORDS = 32
#: Shingles that are reduced to one row before rows are aggregated.
STEP = 4
#: Lines named in a broadcast at most (8 bytes each); beyond that they are joined by a shuffle.
MOST_SENT = 2_000_000
#: Pairs across components up to which a band is scanned, whatever its differences would cost.
SCANNED = 1 << 20
#: More than the lines of a text.
LINE_NUMBERS = 1 << 31


def _plain(raw: Column) -> Column:
    """The form of a line that is compared. White space is replaced only where there is more of it than single blanks."""
    odd = F.contains(raw, F.lit("  "))
    for sign in "\t\r\f\v":
        odd = odd | F.contains(raw, F.lit(sign))
    return F.lower(F.trim(F.when(odd, F.regexp_replace(raw, r"\s+", " ")).otherwise(raw)))


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, line_no, line, more) of every line that isn't blank; line is in the form that is compared."""
    rows = docs.select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).where(F.col("raw").rlike(r"\S"))
    return rows.select("doc_id", "line_no", *more, _plain(F.col("raw")).alias("line"))


def _key(line: Column) -> Column:
    """Two 64-bit hashes, which name a line; the first one names it among links."""
    return F.struct(F.xxhash64(F.lit(1), line).alias("h"), F.xxhash64(F.lit(2), line).alias("l"))


def _hashes(line: Column) -> Column:
    """The hashes of the shingles of a line, without repeats. Four bytes a character make places computable."""
    def each(wide: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(wide) / 4 - WIDTH).cast("int"))
        return F.transform(places, lambda i: F.xxhash64(F.substring(wide, i * 4 + 1, 4 * WIDTH)))

    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), each)))


def signatures(lines: DataFrame) -> DataFrame:
    """(h, m0, m1, ..) of each distinct line of (line), h being the first hash of its ``_key``. Rows of ``STEP`` shingles are made and
    aggregated within the task; the last shingle fills up the last row."""
    wide = lines.select(F.xxhash64(F.lit(1), "line").alias("h"), F.encode("line", "UTF-32").alias("wide"))
    wide = wide.select("h", "wide", F.greatest(F.lit(0), (F.octet_length("wide") / 4 - WIDTH).cast("int")).alias("last"))
    each = wide.select("h", "wide", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(STEP))).alias("i"))
    hashed = [F.hash(F.substring("wide", F.least(F.col("i") + j, F.col("last")) * 4 + 1, F.lit(4 * WIDTH))).alias(f"x{j}") for j in range(STEP)]
    spread = [((k * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF) - (1 << 31) for k in range(MINIMA)]
    least = [F.least(*[F.col(f"x{j}").bitwiseXOR(F.lit(c)) for j in range(STEP)]).alias(f"m{k}") for k, c in enumerate(spread)]
    return each.select("h", *hashed).select("h", *least).groupBy("h").agg(*[F.min(f"m{k}").alias(f"m{k}") for k in range(MINIMA)])


def members(k: int) -> tuple[int, ...]:
    """The minima of a band: places that differ by 1, 7 and 8, so that two bands have one in common at most."""
    return tuple((7 * k + step) % MINIMA for step in (0, 1, 8))


def _texts(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(rep, content) of the lines (h, line) named by keys (rep, each once)."""
    few = keys.count() <= MOST_SENT
    named = lines.select(F.col("h").alias("rep"), F.col("line").alias("content"))
    return named.join(F.broadcast(keys) if few else keys, "rep", "left_semi").distinct()


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, keep) of every line that isn't blank: the first line of its
    component, and whether it is that line itself."""
    return _marked(docs)


def _agreed() -> Column:
    """Whether the minima a_m0, .. and b_m0, .. agree often enough."""
    return sum(((F.col(f"a_m{k}") == F.col(f"b_m{k}")).cast("int") for k in range(MINIMA)), F.lit(0)) >= AGREED


def _sides(x: DataFrame, y: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """x and y with a_ and b_ before the names of their columns, ``by`` left out."""
    return tuple(some.select(*by, *[F.col(c).alias(f"{side}_{c}") for c in some.columns if c not in by]) for some, side in ((x, "a"), (y, "b")))


def _costly(lists: DataFrame) -> DataFrame:
    """The keys of lists (key, rep, component) with more than ``SCANNED`` pairs across components."""
    parts = lists.groupBy("key", "component").agg(F.count("*").alias("n"))
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within")).where(f"n * n - within > {2 * SCANNED}").select("key")


def _links(lines: DataFrame) -> DataFrame:
    """Links (a, b) between the hashes h of lines (h, line) that connect all lines that are connected."""
    signed = staged(signatures(lines.select("line")), "signatures")
    bands = signed.select("h", F.explode(F.array(*[F.xxhash64(F.lit(k), *[f"m{i}" for i in members(k)]) for k in range(BANDS)])).alias("key"))
    dealt = bands.repartition("key")
    several = dealt.groupBy("key").agg(F.min("h").alias("centre"), F.max("h").alias("hi")).where("centre < hi").select("key", "centre")
    met = staged(dealt.join(several.hint("shuffle_hash"), "key").select("key", F.col("h").alias("rep"), "centre"), "bands")

    ends = staged(met.select("rep").distinct(), "line-ends")
    texts = staged(_texts(lines, ends).join(signed.withColumnRenamed("h", "rep"), "rep"), "line-texts")
    x, y = _sides(texts, texts)
    stars = met.where("rep > centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(x, F.col("a") == F.col("a_rep")).join(y, F.col("b") == F.col("b_rep")).where(_agreed())
    stars = staged(stars.select("a", "b", differences.linking("a_content", "b_content", _hashes, PERCENT).alias("link")), "line-stars")
    links = stars.where("link").select("a", "b")

    marked = staged(open_lists(renamed(met.select("key", "rep"), links), ["key"]).where("length > 2"), "open-bands")
    dropped(met, ends, signed)
    sized = marked.join(_costly(marked), "key").join(texts.select("rep", F.char_length("content").cast("long").alias("n")), "rep")
    deep = staged(differences.deep_lists(sized), "deep-bands")
    long = marked.join(deep, "key", "left_semi")
    if not deep.isEmpty():
        some = staged(texts.select("rep", "content").join(long.select("rep").distinct(), "rep"), "long-texts")
        links = links.unionByName(differences.links_of(long, some, _hashes, links, PERCENT))
        dropped(some)
    short = marked.join(deep, "key", "left_anti").select("key", "rep", "component")
    wanted = staged(texts.join(short.select("rep").distinct(), "rep"), "short-texts")
    known = staged(_sketches(wanted).join(wanted.drop("content"), "rep"), "line-sketches")
    apart = short.join(known, "rep")
    across = staged(_near(apart, apart).join(stars, ["a", "b"], "left_anti"), "lines-across")
    links = staged(links.unionByName(verified(across, wanted, _hashes, PERCENT)), "all-line-links")
    dropped(stars, texts, marked, deep, wanted, known, across)
    return links


def _sketches(texts: DataFrame) -> DataFrame:
    """(rep, n, s0, s1, ..) of texts (rep, content): the number of its shingles, repeats counted, and a bitmap that has a bit for each
    of their hashes. Words of bitmaps are made within the task that reads the text."""
    wide = texts.select("rep", F.encode("content", "UTF-32").alias("wide"))
    wide = wide.select("rep", "wide", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("wide") - (4 * WIDTH - 1)), F.lit(4))).alias("i"))
    each = wide.select("rep", F.xxhash64(F.substring("wide", F.col("i"), F.lit(4 * WIDTH))).alias("x"))
    each = each.select("rep", F.expr(f"(x >> 6) & {WORDS - 1}").alias("word"), F.expr("shiftleft(1L, CAST(x & 63 AS INT))").alias("bit"))
    each = each.groupBy("rep", "word").agg(F.count("*").alias("n"), F.bit_or("bit").alias("bits"))
    words = [F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0)).alias(f"s{w}") for w in range(WORDS)]
    return each.groupBy("rep").agg(F.sum("n").alias("n"), *words)


def _near(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of the same list in different components that agree in enough minima and may link: where one
    bitmap only has a bit, one set has a hash that the other lacks, so that sets differ in as many hashes at least."""
    a, b = _sides(x, y, "key")
    differ = sum((F.bit_count(F.col(f"a_s{w}").bitwiseXOR(F.col(f"b_s{w}"))) for w in range(WORDS)), F.lit(0))
    met = (F.col("a_rep") < F.col("b_rep")) & (F.col("a_component") != F.col("b_component")) & _agreed() & (differ * (100 + PERCENT) <= (F.col("a_n") + F.col("b_n")) * (100 - PERCENT))
    return a.join(b, "key").where(met).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()


def _place(doc_id: str, more: tuple[str, ...]) -> Column:
    """What orders places, rows without doc_id last: one number where doc_id, of the type ``doc_id``, is a whole one, since minima of
    numbers are found by hashing and those of structures by sorting."""
    if more or doc_id not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line_no", *more)
    return F.coalesce(F.col("doc_id").cast("decimal(20, 0)"), F.lit(str(1 << 63)).cast("decimal(20, 0)")) * F.lit(LINE_NUMBERS) + F.col("line_no")


def _taken_apart(doc_id: str, more: tuple[str, ...]) -> list[Column]:
    """class_doc_id and class_line_no of the column ``head``, made by ``_place``."""
    if more or doc_id not in ("tinyint", "smallint", "int", "bigint"):
        return [F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no")]
    line_no = F.pmod("head", F.lit(LINE_NUMBERS))
    named = F.col("head") < F.lit(str(1 << 63)).cast("decimal(20, 0)") * F.lit(LINE_NUMBERS)
    return [F.when(named, (F.col("head") - line_no) / F.lit(LINE_NUMBERS)).cast(doc_id).alias("class_doc_id"), line_no.cast("int").alias("class_line_no")]


def _marked(docs: DataFrame, *more: str) -> DataFrame:
    """As ``duplicates``, with the columns ``more``, which also order equal lines with equal places."""
    key = _key(F.col("line"))
    lines = staged(_lines(docs, *more).select("doc_id", "line_no", *more, "line", key["h"].alias("h"), key["l"].alias("l"), F.monotonically_increasing_id().alias("id")), "lines")
    kind = dict(docs.dtypes)["doc_id"]
    placed = lines.select("h", "l", "id", _place(kind, more).alias("at"))
    classes = staged(placed.groupBy("h", "l").agg(F.min("at").alias("first"), F.min_by("id", "at").alias("first_id")), "line-classes")
    # a line without links is a component of its own
    linked = staged(classes.join(components(_links(lines)), F.col("h") == F.col("vertex")).select("h", "l", "first", "first_id", "component"), "linked-lines")
    heads = linked.groupBy("component").agg(F.min("first").alias("top"), F.min_by("first_id", "first").alias("top_id"))
    ranked = classes.join(linked.join(heads, "component").select("h", "l", "top", "top_id"), ["h", "l"], "left")
    ranked = ranked.select("h", "l", F.coalesce("top", "first").alias("head"), F.coalesce("top_id", "first_id").alias("head_id"))
    out = lines.select("doc_id", "line_no", *more, "h", "l", "id").join(ranked, ["h", "l"])
    return out.select("doc_id", "line_no", *more, *_taken_apart(kind, more), (F.col("id") == F.col("head_id")).alias("keep"))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row of docs, without the lines that are dropped; a row whose lines all go has an empty
    text. Of repeated rows one keeps its lines. Rows are told apart by doc_id and text, and copies are counted."""
    row = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.md5(F.col("text").cast("binary")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row)
    rows = staged(rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies")), "line-rows")
    drop = _marked(rows, "row").where("not keep").select("row", "line_no")
    each = rows.select("row", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    kept = each.join(drop, ["row", "line_no"], "left_anti").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("x"))
    text = kept.select("row", F.array_join(F.col("x.raw"), "\n").alias("first"))
    blank = F.array_join(F.filter(F.split("text", "\n"), lambda raw: _plain(raw) == ""), "\n")
    out = rows.join(text, "row", "left").select("doc_id", F.coalesce("first", F.lit("")).alias("first"), blank.alias("later"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select("doc_id", F.when(F.col("copy") == 1, F.col("first")).otherwise(F.col("later")).alias("text"))
