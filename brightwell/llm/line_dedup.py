"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line, in lower case and without outer white space, has as shingles the K characters from each
of its characters on; a line of fewer than K characters is its own shingle. Each shingle has one
64-bit hash, and the VALUES minima of that hash under as many rotations are the line's signature.
Pairs of these minima are its bands: at a Jaccard similarity of 0.8, two lines share a band with a
chance of 0.995. Six bits of each minimum are its sketch: lines of a band whose sketches agree in
fewer than AGREE of the VALUES are not compared further (of pairs at 0.8 that costs 0.3 %; by
tests, recall is over 0.99 in all). Next come their marks, one bit of 64 * WORDS for each shingle
hash, turned over by each different shingle of the line. Shingles that two lines share cancel out, so the
bits in which they differ bound their similarity from above, closely, which loses no pair.
All others are verified by the exact Jaccard similarity of their shingle sets, and a distributed
union-find joins them. Of each component the line of the first position stays: by document id
(null last), then by the text's hash, then by its place in the document.

In bands of up to SMALL lines all pairs whose sketches agree are verified; in larger ones each line
against LEADERS of the band's lines. Bands that then still hold several components get FURTHER leaders,
in ROUNDS, so that a dense group is one component before any of its pairs are made. Those that are open
still are compared in pairs across components, after sketches and marks. Before that, bands of over MANY lines are split by
further values of their sketches, one after the other, until a group has few lines or all of it agrees
in AGREE values: a line goes to one group for each value, so no agreeing pair is lost. Groups that
agree and still hold over MANY lines are compared where lines share one of their rarest shingles and
have enough left from there on (prefix and position filtering, which lose no pair). So copies and dense
groups never yield their square, nor do lines that share a passage but no more. Equal lines count as
one throughout, however many there are.

Defined cases: a line without a word is never removed; a null text stays null; rows that repeat
both id and text share one decision; a text of which all lines go becomes empty; a very long line
is hashed CHUNK characters at a time. An empty table gives an empty table. Columns are kept
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwell.llm.components import connected_components
from brightwell.llm.shared import drop_path, written

K = 9
VALUES, BANDS, AGREE = 10, 5, 5
SIMILAR = 0.8
#: Words of 64 bits in a line's marks.
WORDS = 32
#: Ids of lines or bands, of 8 bytes each, that are few enough to be sent to every task.
FEW_IDS = 2_000_000
#: Lines of a band that are compared in all pairs at once.
SMALL = 8
#: Lines of a larger band that all its others are held against before pairs across components.
LEADERS = 2
#: Further leaders of a band of several components in each round, and the rounds before pairs across components.
FURTHER, ROUNDS = 4, 2
#: Lines of a group of several components that are compared pair by pair at most.
MANY = 2000
#: Rounds in which each line has a pair or two verified before all that are left, where there are more pairs than lines.
PICKS = 2
#: Shingles of a line that are one row on the way to its minima.
AT_ONCE = 8
CHUNK = 4096
_OUTER = " \t\n\x0b\x0c\r"


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(_OUTER)))


def _rotated(hash_: Column, bits: int) -> Column:
    return F.shiftleft(hash_, bits).bitwiseOR(F.shiftrightunsigned(hash_, 64 - bits)) if bits else hash_


def _hashed(lines: DataFrame, k: int, at_once: int = 1) -> DataFrame:
    """(id, at, h0, h1, ...): a row for at_once shingles of normal lines (id, line), cut from UTF-32, where each character has its place.

    Where a line has no more of them, its last one is repeated.
    """
    last = F.greatest(F.col("size") - k, F.lit(0))
    cut = lines.select("id", F.encode("line", "utf-32").alias("wide"), F.length("line").alias("size"))
    cut = cut.select("id", "wide", last.alias("last"), F.explode(F.sequence(F.lit(0), last, F.lit(CHUNK))).alias("start"))
    cut = cut.select("id", "wide", "last", F.explode(F.sequence("start", F.least(F.col("start") + (CHUNK - 1), F.col("last")), F.lit(at_once))).alias("at"))
    return cut.select("id", "at", *[F.xxhash64(F.substring("wide", F.least(F.col("at") + i, F.col("last")) * 4 + 1, F.lit(4 * k))).alias(f"h{i}") for i in range(at_once)])


def signatures(lines: DataFrame, k: int = K) -> DataFrame:
    """(id, n, k0, k1, ..., sketch) of the distinct ones of normal lines (id, line): n rows have that line.

    AT_ONCE shingles are a row that is counted into its line's minima before the shuffle.
    """
    lowest = [F.least(*[_rotated(F.col(f"h{j}"), 64 * i // VALUES) for j in range(AT_ONCE)]) for i in range(VALUES)]
    least = _hashed(lines, k, AT_ONCE).groupBy("id").agg(F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("n"), *[F.min(m).alias(f"m{i}") for i, m in enumerate(lowest)])
    keys = [F.xxhash64(F.lit(i), f"m{i}", f"m{i + BANDS}").alias(f"k{i}") for i in range(BANDS)]
    sketch = F.lit(0).cast("long")
    for i in range(VALUES):
        sketch = sketch.bitwiseOR(F.shiftleft(F.col(f"m{i}").bitwiseAND(63), 6 * i))
    return least.select("id", "n", *keys, sketch.alias("sketch"))


def marks(lines: DataFrame, n_lines: int, k: int = K) -> DataFrame:
    """(id, marks) of about n_lines distinct normal lines (id, line): the number of different shingles, and the parity of those of each bit."""
    lines = lines.repartition(1 + n_lines // 2_500, "id")  # the only shuffle: what follows is grouped by id first
    # Repeats are told within a line's array, which costs less than to group them; arrays only of lines of bounded length.
    # Outer, although there is always one shingle: else a filter on the array may make it once more.
    own = lines.where(F.length("line") <= CHUNK).select("id", F.explode_outer(F.array_distinct(shingles(F.col("line"), k))).alias("h"))
    long = _hashed(lines.where(F.length("line") > CHUNK), k).select("id", F.col("h0").alias("h")).distinct()
    return _parities(own).unionByName(_parities(long))


def _parities(own: DataFrame) -> DataFrame:
    """(id, marks) of the different shingles (id, h) of lines, which are grouped by id before."""
    bits = own.select("id", F.shiftrightunsigned("h", 6).bitwiseAND(WORDS - 1).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int")).alias("bit"))
    words = bits.groupBy("id", "word").agg(F.bit_xor("bit").alias("bits"), F.count("*").alias("size"))
    held = words.groupBy("id").agg(F.sum("size").alias("size"), *[F.max(F.when(F.col("word") == w, F.col("bits"))).alias(f"w{w}") for w in range(WORDS)])
    return held.select("id", F.struct("size", *[F.coalesce(f"w{w}", F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)]).alias("marks"))


def _agreeing(differ: Column) -> Column:
    """Whether two sketches that differ in these bits agree in AGREE of their values or more."""
    return sum((F.when(differ.bitwiseAND(63 << 6 * i) == 0, 1).otherwise(0) for i in range(VALUES)), F.lit(0)) >= AGREE


def _agree(one: str, other: str) -> Column:
    return _agreeing(F.col(one).bitwiseXOR(F.col(other)))


def _may_be_similar(one: str, other: str, similar: float) -> Column:
    """False only for marks of lines that are less similar: with sizes s in all and d differences, similarity is (s - d) / (s + d)."""
    share, size = round(similar * 10_000), F.col(f"{one}.size") + F.col(f"{other}.size")
    differ = sum((F.bit_count(F.col(f"{one}.w{w}").bitwiseXOR(F.col(f"{other}.w{w}"))) for w in range(WORDS)), F.lit(0))
    return size * (10_000 - share) >= differ * (10_000 + share)


def shingles(line: Column, k: int = K) -> Column:
    """The hashes of a normal line's shingles, repeats included, as in _hashed."""
    cut = lambda held: F.transform(F.sequence(F.lit(0), held["last"]), lambda at: F.xxhash64(F.substring(held["wide"], at * 4 + 1, F.lit(4 * k))))
    held = F.array(F.struct(F.encode(line, "utf-32").alias("wide"), F.greatest(F.length(line) - k, F.lit(0)).alias("last")))
    return F.get(F.transform(held, cut), F.lit(0))


def similar_lines(one: Column, other: Column, similar: float) -> Column:
    """Whether the Jaccard similarity of two normal lines' shingle sets is similar or more; in whole numbers."""
    share = round(similar * 10_000)
    held = F.array(F.struct(shingles(one).alias("a"), shingles(other).alias("b")))  # each is used twice and made once
    return F.get(F.transform(held, lambda x: F.size(F.array_intersect(x["a"], x["b"])) * 10_000 >= F.size(F.array_union(x["a"], x["b"])) * share), F.lit(0))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, line_no, id, line) of every line with a word, line in normal form."""
    text = F.col(f"`{text_col}`").cast("string")
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    # A filter on the normal form would put each line in lower case twice.
    lines = lines.where(F.btrim("line", F.lit(_OUTER)) != "").select("doc_id", "text_hash", "line_no", normal(F.col("line")).alias("line"))
    return lines.select("doc_id", "text_hash", "line_no", F.xxhash64("line").alias("id"), "line")


def _marked(pairs: DataFrame, marked: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) whose marks allow that they are similar."""
    for end in ("a", "b"):
        pairs = pairs.join(marked.select(F.col("id").alias(end), F.col("marks").alias(f"marks_{end}")), end)
    return pairs.where(_may_be_similar("marks_a", "marks_b", similar)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) whose lines are similar."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    return two.where(similar_lines(F.col("line_a"), F.col("line_b"), similar)).select("a", "b")


def _leads(rows: DataFrame, numbers: range, by: list[str]) -> DataFrame:
    """A line of each band for each of the numbers, drawn by some columns, with the other columns of rows (band, id, ...)."""
    drawn = rows.groupBy("band").agg(*[F.min(F.struct(F.xxhash64(*by, F.lit(i)).alias("draw"), *[c for c in rows.columns if c != "band"])).alias(f"lead{i}") for i in numbers])
    return drawn.select("band", F.explode(F.array(*[f"lead{i}" for i in numbers])).alias("lead")).select("band", "lead.*").drop("draw").distinct()


def _open_bands(placed: DataFrame) -> DataFrame:
    """(band, id, sketch, root, last, n, varies) of the bands, of n lines, that hold several components; varies: bits of sketches that are not equal in all."""
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_and("sketch").bitwiseXOR(F.bit_or("sketch")).alias("varies"))
    return placed.join(several.where("low < high").drop("low", "high"), "band").select("band", "id", "sketch", "root", "last", "n", "varies")


def _narrower(open_: DataFrame) -> DataFrame:
    """(band, id, sketch, root, last) with a row of each line for each value after last in which its band is not one.

    Two lines of a band that agree in AGREE values, not all of them common to it, meet in that of their next one.
    """
    parts = [F.when((F.col("last") < i) & (F.col("varies").bitwiseAND(63 << 6 * i) != 0), F.struct(F.lit(i).alias("last"), F.xxhash64("band", F.lit(i), F.col("sketch").bitwiseAND(63 << 6 * i)).alias("band"))) for i in range(VALUES)]
    return open_.select("id", "sketch", "root", F.explode(F.array(*parts)).alias("to")).where("to is not null").select("to.band", "id", "sketch", "root", "to.last")


def _crossing(rows: DataFrame, others: DataFrame, by: list[str], meet: Column) -> DataFrame:
    """Pairs (a, b) of a row and another (*by, id, root, ...) that are equal in by and fulfil meet, on x_a and x_b for columns x."""
    left, right = (df.select(*[F.col(c).alias(n if c == "id" else f"{c}_{n}") for c in df.columns]) for df, n in ((rows, "a"), (others, "b")))
    for c in by:
        meet &= F.col(f"{c}_a") == F.col(f"{c}_b")
    return left.join(right, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _led(open_: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each line of an open band and FURTHER leaders of it in other components, if their sketches agree."""
    rows = open_.select("band", "id", "sketch", "root")
    first = LEADERS + turn * FURTHER
    return _crossing(rows, _leads(rows, range(first, first + FURTHER), ["band", "id"]), ["band"], (F.col("root_a") != F.col("root_b")) & _agree("sketch_a", "sketch_b"))


def _rare(rows: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(shingle, id, root, sketch, size, left, short) for each line's rarest shingles that another line has too.

    The shingles of a line in one order for all, rarest first: from the first that two similar lines have in
    common, left are at least as many in each as they have in common. So that one is among the rarest, of a share
    of 1 - similar, of the line of no fewer shingles, and among the other's short ones, (1 - similar) / (1 + similar).
    """
    share = round(similar * 10_000)
    own = rows.select("id", "root", "sketch").distinct().join(texts, "id").select("id", "root", "sketch", F.array_distinct(shingles(F.col("line"))).alias("own"))
    # Outer, although there is always one: else a filter that makes all texts' shingles goes below the join.
    dealt = own.select("id", "root", "sketch", F.size("own").cast("long").alias("size"), F.explode_outer("own").alias("shingle"))
    counted = dealt.join(dealt.groupBy("shingle").agg(F.count("*").alias("lines")).where("lines > 1"), "shingle", "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("lines", F.lit(1)), "shingle"))
    placed = counted.select("shingle", "id", "root", "sketch", "size", "lines", (F.col("size") - place + 1).alias("left"))
    rarest = placed.where((F.col("left") * 10_000 >= F.col("size") * share) & F.col("lines").isNotNull())
    return rarest.select("shingle", "id", "root", "sketch", "size", "left", (F.col("left") * (10_000 + share) >= F.col("size") * (2 * share)).alias("short"))


def _extended(links: DataFrame, found: DataFrame, n_lines: int) -> tuple[DataFrame, list[str]]:
    """(node, root) of components with more links between them, over n_lines lines at most, and where it is written if there are any."""
    links, links_at = written(links, "line-links", n_lines, 5_000)
    paths = []
    if links.limit(1).count():
        # A component's lines are one node by now: only links between roots are new.
        root = lambda end: found.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        lifted = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).distinct()
        lifted, lifted_at = written(lifted, "line-links", n_lines)
        joined, joined_at = connected_components(lifted, "line-components")
        joined = joined.withColumnsRenamed({"node": "old", "root": "new"})
        known = found.unionByName(lifted.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
        found = known.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).distinct()
        found, at = written(found, "line-classes", n_lines)
        paths.append(at)
        for path in (lifted_at, joined_at):
            drop_path(links.sparkSession, path)
    drop_path(links.sparkSession, links_at)
    return found, paths


def _joined(pairs: DataFrame, texts: DataFrame, found: DataFrame, n_lines: int, similar: float) -> tuple[DataFrame, list[str]]:
    """(node, root) of components with the links among pairs (a, b), and where it is written if any is new.

    While there are more pairs than lines, each line has one or two of its pairs verified in PICKS rounds, so that a
    dense group becomes few components soon; then come all pairs whose lines are in different components still.
    """
    spark, paths = pairs.sparkSession, []
    left, left_at = written(pairs, "line-pairs", n_lines, 5_000)
    for turn in range(PICKS + 1):
        if not (n_left := left.count()):
            break
        if last := turn == PICKS or n_left <= n_lines:
            found, more = _extended(_verified(left, texts, similar), found, n_lines)
        else:
            drawn = left.withColumn("draw", F.xxhash64("a", "b"))
            for end in ("a", "b"):
                drawn = drawn.join(drawn.groupBy(end).agg(F.min("draw").alias(f"draw_{end}")), end)
            drawn, drawn_at = written(drawn.select("a", "b", ((F.col("draw") == F.col("draw_a")) | (F.col("draw") == F.col("draw_b"))).alias("now")), "line-pairs", n_lines, 5_000)
            found, more = _extended(_verified(drawn.where("now").select("a", "b"), texts, similar), found, n_lines)
            rest = drawn.where("not now").select("a", "b")
            for end in ("a", "b"):
                rest = rest.join(found.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
            rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
            before, (left, left_at) = left_at, written(rest, "line-pairs", n_lines, 5_000)
            for at in (before, drawn_at):
                drop_path(spark, at)
        if more:
            for at in paths:
                drop_path(spark, at)
            paths = more
        if last:
            break
    drop_path(spark, left_at)
    return found, paths


def _groups(open_: DataFrame, many: int, spent: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Open bands of up to many lines, and larger ones that agree in AGREE values, if any; others are split until they are either."""
    few, agreeing = open_.where(F.col("n") <= many), None
    wide = open_.where(F.col("n") > many)
    while wide.limit(1).count():
        one = _agreeing(F.col("varies"))
        agreeing = wide.where(one) if agreeing is None else agreeing.unionByName(wide.where(one))
        narrower, at = written(_open_bands(_narrower(wide.where(~one))), "line-open")
        spent.append(at)
        few, wide = few.unionByName(narrower.where(F.col("n") <= many)), narrower.where(F.col("n") > many)
    return few, agreeing


def _near(open_: DataFrame, texts: DataFrame, marked: DataFrame, similar: float, many: int, spent: list[str]) -> DataFrame:
    """Pairs (a, b) across components of open bands that may be similar by sketches and marks; spent gets what is written for them."""
    few, agreeing = _groups(open_, many, spent)
    may = _agree("sketch_a", "sketch_b") & _may_be_similar("marks_a", "marks_b", similar)
    pairs = _crossing(*[few.select("band", "id", "sketch", "root").join(marked, "id")] * 2, ["band"], (F.col("root_a") < F.col("root_b")) & may)
    if agreeing is None or not agreeing.limit(1).count():
        return pairs
    rare, at = written(_rare(agreeing, texts, similar), "line-rare")
    spent.append(at)
    share = round(similar * 10_000)
    enough = F.least("left_a", "left_b") * (10_000 + share) >= (F.col("size_a") + F.col("size_b")) * share
    rare = _crossing(rare, rare.where("short"), ["shingle"], (F.col("root_a") != F.col("root_b")) & (F.col("size_a") >= F.col("size_b")) & enough & _agree("sketch_a", "sketch_b"))
    return pairs.unionByName(_marked(rare, marked, similar)).distinct()


def line_components(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> tuple[DataFrame, DataFrame, list[str]]:
    """Places of lines, components, and what is written for these.

    (id, doc_id, text_hash, line_no) of every line that occurs twice or met another in a band,
    and (node, root) of the lines with a link.
    """
    spark = docs.sparkSession
    signed, signed_at = written(signatures(_numbered(docs, id_col, text_col).select("id", "line")), "line-signatures")
    bands = signed.select("id", "sketch", F.explode(F.array(*[f"k{i}" for i in range(BANDS)])).alias("band"))
    # Of two lines alone in a band the sketches are held against each other at once; most bands that meet by chance end here.
    live = bands.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.bit_xor("sketch").alias("differ"))
    live = live.where(F.col("first") < F.col("last")).where((F.col("n") > 2) | _agreeing(F.col("differ"))).select("band", "first", "last", "n")
    live, live_at = written(live, "line-bands")
    larger = live.where("n > 2").select("band", "n")
    met, met_at = written(bands.join(F.broadcast(larger) if larger.count() <= FEW_IDS else larger, "band").select("band", "id", "sketch", "n"), "line-met")
    small, wide = met.where(F.col("n") <= SMALL), met.where(F.col("n") > SMALL)
    meet = lambda left, right, on: left.select("band", F.col("id").alias("a"), F.col("sketch").alias("sketch_a")).join(right.select("band", F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "band").where(on & _agree("sketch_a", "sketch_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    leads = _leads(wide.select("band", "id", "sketch"), range(LEADERS), ["id"])
    pairs = live.where("n = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    pairs = pairs.unionByName(meet(small, small, F.col("a") < F.col("b"))).unionByName(meet(wide, leads, F.col("a") != F.col("b"))).distinct()
    pairs, pairs_at = written(pairs, "line-pairs")
    drop_path(spark, live_at)
    n_pairs = pairs.count()
    # One more reading of the documents gives the texts of lines that met, and all places of these and of lines that repeat.
    compared = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(wide.select("id")).select("id", F.lit(True).alias("has_met"))
    concerned = signed.where("n > 1").select("id", F.lit(False).alias("has_met")).unionByName(compared).groupBy("id").agg(F.max("has_met").alias("has_met"))
    concerned, concerned_at = written(concerned, "line-concerned")
    drop_path(spark, signed_at)
    n_concerned = concerned.count()
    few = n_concerned <= FEW_IDS
    places = _numbered(docs, id_col, text_col).join(F.broadcast(concerned) if few else concerned, "id").select("id", "doc_id", "text_hash", "line_no", F.when(F.col("has_met"), F.col("line")).alias("line"))
    places, places_at = written(places, "line-places")
    drop_path(spark, concerned_at)
    texts, texts_at = written(places.where("line is not null").select("id", "line").dropDuplicates(["id"]), "line-texts", n_concerned)
    marked, marked_at = written(marks(texts, n_concerned), "line-marks", n_concerned, 50_000)
    links, links_at = written(_verified(_marked(pairs, marked, similar), texts, similar), "line-links", n_pairs, 5_000)
    found, found_at = connected_components(links, "line-components")
    paths, spent = [places_at, found_at], [met_at, pairs_at, texts_at, marked_at, links_at]
    # Larger bands that still hold several components: further leaders, then what may be similar across these.
    n_open = wide.count()
    for turn in range(ROUNDS + 1):
        placed = (open_ if turn else wide).select("band", "id", "sketch").join(found, F.col("id") == F.col("node"), "left").select("band", "id", "sketch", F.coalesce("root", "id").alias("root"), F.lit(-1).alias("last"))
        open_, open_at = written(_open_bands(placed), "line-open", n_open)
        spent.append(open_at)
        if not (n_open := open_.count()):
            break
        if turn < ROUNDS:
            found, more = _extended(_verified(_marked(_led(open_, turn), marked, similar), texts, similar), found, n_concerned)
        else:
            found, more = _joined(_near(open_, texts, marked, similar, many, spent), texts, found, n_concerned, similar)
        paths += more
    for at in spent:
        drop_path(spark, at)
    return places.select("id", "doc_id", "text_hash", "line_no"), found, paths


def removals(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> tuple[DataFrame, list[str]]:
    """(doc_id, text_hash, gone): the places of the lines that go, for each document that loses any; and what is written for it."""
    lines, found, paths = line_components(docs, similar, id_col, text_col, many)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "line_no")
    per_id = lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    rooted = per_id.join(found, per_id["id"] == found["node"], "left").select("id", "first", "n", F.coalesce("root", "id").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where("all > 1").select("root", "kept")
    decided = rooted.join(kept, "root").select("id", "kept")
    gone = lines.join(decided, "id").where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash")) & (F.col("line_no") == F.col("kept.line_no"))))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone")), paths


def dedup_lines(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", counts: bool = False) -> DataFrame:
    """docs with the lines that go taken out of text_col, and length_col, if there, counted anew.

    With counts, the columns n_lines and n_removed follow, in place of any of that name.
    """
    gone, paths = removals(docs, similar, id_col, text_col)
    gone, _ = written(gone, "line-removals")
    for at in paths:
        drop_path(docs.sparkSession, at)
    text = docs[f"`{text_col}`"].cast("string")
    hit = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].cast("long").alias("own_id"), F.xxhash64(text).alias("own_hash"))
    joined = hit.join(gone, hit["own_id"].eqNullSafe(gone["doc_id"]) & (hit["own_hash"] == gone["text_hash"]), "left").select("row", "gone")
    # parts and stay are each used twice below, so they stay in projections of their own.
    joined = joined.select("row", "gone", F.split(F.col(f"row.`{text_col}`").cast("string"), "\n").alias("parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    joined = joined.select("row", "gone", "parts", F.when(F.col("gone").isNotNull(), F.sort_array(stay)).alias("stay"))
    rest = F.array_join(F.transform("stay", lambda i: F.get(F.col("parts"), i)), "\n")
    joined = joined.select("row", "gone", F.size("parts").alias("size"), F.when(F.col("stay").isNull(), F.col(f"row.`{text_col}`")).otherwise(rest).alias("kept_text"))
    out = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        if c == text_col:
            old = F.col("kept_text")
        elif c == length_col:
            old = F.when(F.col("gone").isNull(), old).otherwise(F.length("kept_text")).cast(docs.schema[c].dataType)
        if not (counts and c in ("n_lines", "n_removed")):
            out.append(old.alias(c))
    if counts:
        out += [F.when(F.col("size") > 0, F.col("size")).otherwise(0).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")]
    return joined.select(*out)
