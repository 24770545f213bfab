"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line of l characters is split into THRESHOLD + 1 even segments, which are indexed by l, their number and
their hash. A line within THRESHOLD edits of it holds one of these segments unchanged, shifted by no more than
the edits on either side can shift it; so each line probes, for each length up to THRESHOLD shorter, only the
substrings at those places. Candidates are verified by a bit-parallel edit distance, of which only the band
around the diagonal is computed.

What is asked for are classes, not pairs: a key's lines are compared with one of its indexed lines, then with
another, and only lines of keys that still hold several classes are compared across these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, likely
from scoreloom.llm.components import components

#: Edits between linked lines, and the characters of the shortest lines that may be linked to different ones.
THRESHOLD, SHORTEST = 2, 20
#: Candidates are first told apart by how often these occur in them.
COUNTED = ("e", "a", "t", "o", "i", "n", "s", "r", " ", "0123456789")


def segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start from 1, characters) of segment i from 0 in a line of that length: even, the longer ones last."""
    longer = length % parts
    base = ((length - longer) / parts).cast("int")
    return F.lit(1) + i * base + F.greatest(F.lit(0), i - parts + longer), base + (i >= F.lit(parts) - longer).cast("int")


def places(threshold: int = THRESHOLD) -> list[tuple[int, int, int]]:
    """(shorter, i, shift): where a line may hold segment i of a line as long or up to threshold shorter; the line's own segments come first.

    Edits before the segment shift it by i at most, edits after it by what is left of the threshold. Each place lies within any line of more than twice
    the threshold's characters; in shorter ones some give a piece cut short, which can only add candidates.
    """
    found = [
        (shorter, i, shift)
        for shorter in range(threshold + 1) for i in range(threshold + 1)
        for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1)
    ]
    return sorted(found, key=lambda p: p[0] > 0 or p[2] != 0)


def keyed(lines: DataFrame, at: list[tuple[int, int, int]], threshold: int = THRESHOLD) -> DataFrame:
    """(h, key, own) for each of these places in each of lines (h, line, size); own: it is one of the line's own segments.

    Places are rows, not columns: the key is one short expression, which Spark compiles.
    """
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("shorter", "i", "shift"), p, strict=True)]) for p in at])
    length = F.col("size") - F.col("shorter")
    start, n = segment(length, F.col("i"), threshold + 1)
    key = F.xxhash64(length, "i", F.substring(F.col("line"), start + F.col("shift"), n))
    return lines.select("h", "line", "size", F.inline(rows)).select("h", key.alias("key"), ((F.col("shorter") == 0) & (F.col("shift") == 0)).alias("own"))


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once."""
    return F.transform(F.array(x), then)[0]


def trimmed(a: Column, b: Column, spare: int) -> Column:
    """struct(a, b) without most of the beginning and the end that they share, which takes no edits; spare characters stay."""

    def drop(x: Column, same: Callable[[Column, Column], Column], rest: Callable[[Column, Column], Column]) -> Column:
        n = F.least(F.char_length(x["a"]), F.char_length(x["b"])) - spare
        now = F.struct(x["a"].alias("a"), x["b"].alias("b"), F.greatest(F.lit(0), F.shiftright(n, 1)).alias("k"))
        for _ in range(6):  # a half of what may go, then a quarter, and so on
            now = _let(now, lambda y: F.struct(
                F.when(same(y["a"], y["k"]) == same(y["b"], y["k"]), rest(y["a"], y["k"])).otherwise(y["a"]).alias("a"),
                F.when(same(y["a"], y["k"]) == same(y["b"], y["k"]), rest(y["b"], y["k"])).otherwise(y["b"]).alias("b"),
                F.shiftright(y["k"], 1).alias("k"),
            ))
        return now

    size = F.char_length
    head = _let(F.struct(a.alias("a"), b.alias("b")), lambda x: drop(x, lambda s, k: F.substring(s, F.lit(1), k), lambda s, k: F.substring(s, k + 1, size(s))))
    return _let(head, lambda x: drop(x, lambda s, k: F.substring(s, size(s) - k + 1, k), lambda s, k: F.substring(s, F.lit(1), size(s) - k)))


def edit_distance(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """The edit distance of a and b, -1 if it exceeds threshold; both are longer than threshold.

    What both begin and end with is left out. Bit-parallel along the band: bit k of a column of the matrix stands for the diagonal k - threshold. vp and vn
    hold where values grow and fall down the column; dist follows the lowest diagonal to the last row, and that
    row to its end.
    """
    width = 2 * threshold + 1
    full, top = (1 << width) - 1, 2 * threshold
    state = lambda i, vp, vn, dist: F.struct(i.alias("i"), vp.alias("vp"), vn.alias("vn"), dist.alias("dist"))
    start = state(F.lit(0), F.lit(((1 << (threshold + 1)) - 1) << threshold), F.lit(0), F.lit(threshold))
    bit = lambda x, k: F.shiftright(x, k).bitwiseAND(F.lit(1))
    flip = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(full))

    def next_column(pattern: Column, steep: Column) -> Callable[[Column, Column], Column]:
        def step(now: Column, char: Column) -> Column:
            i, vp, vn = now["i"], now["vp"], now["vn"]
            same = F.lit(0)
            for k in range(width):
                same = same + F.when(F.get(pattern, i + F.lit(k - threshold)) == char, 1 << k).otherwise(0)

            def with_diagonals(d0: Column) -> Column:
                def with_rows(rows: Column) -> Column:
                    right, left, down = rows["right"], rows["left"], F.shiftright(d0, 1)
                    below = F.lit(0)
                    for k in range(top):  # the last row is at bit top - 1 first, and one lower each column
                        below = F.when(i - steep == top - 1 - k, bit(right, k) - bit(left, k)).otherwise(below)
                    dist = now["dist"] + F.when(i < steep, 1 - bit(d0, top)).otherwise(below)
                    return state(i + 1, left.bitwiseOR(flip(down.bitwiseOR(right))), down.bitwiseAND(right), dist)

                rows = F.struct(vn.bitwiseOR(flip(d0.bitwiseOR(vp))).alias("right"), d0.bitwiseAND(vp).alias("left"))
                return _let(rows, with_rows)

            return _let(same, lambda x: _let((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full)), with_diagonals))

        return step

    # the pattern's characters are split once a pair, not once a column
    split = lambda x: F.struct(F.split(x["a"], "").alias("p"), F.split(x["b"], "").alias("t"))
    whole = _let(_let(trimmed(a, b, width + 1), split), lambda x: F.aggregate(x["t"], start, next_column(x["p"], F.size(x["p"]) - threshold), lambda s: s["dist"]))
    near = F.abs(F.char_length(a) - F.char_length(b)) <= threshold
    return F.when(near, _let(whole, lambda d: F.when(d <= threshold, d).otherwise(-1))).otherwise(-1)


def counts(line: Column) -> Column:
    """How often some letters, spaces and digits occur: an edit changes two of these numbers by one at most."""
    size = F.char_length(line)
    return F.struct(*[(size - F.char_length(F.translate(line, group, ""))).alias(f"n{i}") for i, group in enumerate(COUNTED)])


def may_be_near(x: Column, y: Column, threshold: int) -> Column:
    """Whether the counts of two lines allow threshold edits."""
    away = [F.abs(x[f"n{i}"] - y[f"n{i}"]) for i in range(len(COUNTED))]
    return sum(away[1:], away[0]) <= 2 * threshold


def parities(line: Column) -> Column:
    """64 bits, each the parity of the count of some characters: an edit changes two of them at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(bit(c)))


def long_enough(line: Column, shortest: int = SHORTEST) -> Column:
    return F.char_length(F.trim(line)) >= shortest


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no from 0, line) of every line that isn't blank."""
    rows = docs.where("doc_id is not null and text is not null")
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"\S"))


def verify(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """(a, b): the digests k of the lines of those pairs (h1, h2) of hashes that are within threshold edits."""
    one, two = (lines.select(F.col("h").alias(f"h{i}"), F.col("line").alias(f"line{i}"), F.col("k").alias(f"k{i}"), F.col("counts").alias(f"counts{i}")) for i in (1, 2))
    near = may_be_near(F.col("counts1"), F.col("counts2"), threshold)
    both = pairs.join(one, "h1").join(two, "h2").where(near & (edit_distance(F.col("line1"), F.col("line2"), threshold) >= 0))
    return both.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()


def links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): digests of different lines within threshold edits, enough of them for all classes.

    lines has a row or more for each line, with more than threshold characters. A key's rows are those of the lines that
    probe it, of which the first, and later the last, of its indexed lines is compared with all. What a key holds in several classes after that is compared
    across them, unless the counts of their characters already differ too much.
    """
    size = F.char_length("line")
    distinct = lines.select("line").distinct().select(F.xxhash64("line").alias("h"), "line", size.alias("size"))
    probed = places(threshold)
    first = keyed(distinct, probed[: threshold + 1], threshold).groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    probes = keyed(distinct, probed, threshold)
    met = cut(probes.join(first, "key").where((F.col("h") != F.col("lo")) | (F.col("lo") != F.col("hi"))))
    wanted = met.select(F.explode(F.array("h", "lo", "hi")).alias("h")).distinct()
    known = cut(likely(lines.select(F.xxhash64("line").alias("h"), "line"), "h", wanted).distinct().join(wanted, "h", "left_semi").withColumn("k", F.unhex(F.md5("line"))).withColumn("counts", counts(F.col("line"))))

    def pairs(of: DataFrame, hub: str) -> DataFrame:
        return cut(of.where(F.col("h") != F.col(hub)).select(F.least("h", hub).alias("h1"), F.greatest("h", hub).alias("h2")).distinct())

    asked = pairs(met, "lo")
    found = cut(verify(asked, known, threshold))
    many = met.where("lo <> hi")
    if many.isEmpty():
        return found
    # a row a line, which holds its keys, as many as there are places at most: what is known of a line meets it once, not once a key
    held = cut(many.groupBy("h").agg(F.collect_set(F.struct("key", "hi", "own")).alias("held")))

    def mixed() -> DataFrame:
        """The rows of keys that hold several classes; a hash of several lines stands for all of them."""
        named = known.select("h", "k").join(components(found).withColumnRenamed("id", "k"), "k", "left").groupBy("h").agg(F.min(F.coalesce("component", "k")).alias("class"))
        placed = cut(held.join(named, "h")).select("h", "class", F.inline("held"))
        keys = placed.groupBy("key").agg(F.min("class").alias("lo_class"), F.max("class").alias("hi_class")).where("lo_class <> hi_class").select("key")
        return cut(placed.join(keys, "key", "left_semi"))

    more = pairs(mixed(), "hi").join(asked, ["h1", "h2"], "left_anti")
    found = cut(found.unionByName(verify(more, known, threshold)).distinct())
    rest = mixed()
    if rest.isEmpty():
        return found
    # a pair meets in one of the keys it shares: the first of the indexed line's own, and one way if both have the other's
    own_keys = F.array_sort(F.array_distinct(F.filter("held", lambda x: x["own"])["key"]))
    keys = held.select("h", F.array_distinct(F.col("held.key")).alias("keys"), own_keys.alias("own_keys"))
    signs = known.join(rest.select("h").distinct(), "h", "left_semi").select("h", "counts", parities(F.col("line")).alias("sign"))
    left = rest.groupBy("h").agg(F.first("class").alias("class"), F.collect_set(F.struct("key", "own")).alias("rest"))
    rest = cut(left.join(signs, "h").join(keys, "h").select("h", "class", "counts", "sign", "keys", "own_keys", F.inline("rest")))
    other = rest.select("key", *[F.col(c).alias(f"{c}2") for c in ("h", "own", "class", "counts", "sign", "keys", "own_keys")])
    near = (F.bit_count(F.col("sign").bitwiseXOR(F.col("sign2"))) <= 2 * threshold) & may_be_near(F.col("counts"), F.col("counts2"), threshold)
    once = (F.array_min(F.array_intersect("own_keys", "keys2")) == F.col("key")) & (~F.col("own2") | (F.col("h") < F.col("h2")) | (F.array_min(F.array_intersect("own_keys2", "keys")) != F.col("key")))
    last = rest.where("own").join(other, "key").where((F.col("class") != F.col("class2")) & near & once)
    last = last.select(F.least("h", "h2").alias("h1"), F.greatest("h", "h2").alias("h2")).distinct().join(asked.unionByName(more), ["h1", "h2"], "left_anti")
    return found.unionByName(verify(cut(last), known, threshold)).distinct()


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """Per occurrence of a line that isn't blank: doc_id, text_key, line_no, class_doc, class_line, kept.

    Lines are what lies between newlines, counted from 0. Equal lines are one; different lines of shortest
    characters or more, without spaces at the ends, are linked if they are within threshold edits; shorter ones are linked to none.
    A class is what links reach; it is named by its first occurrence by doc_id and line_no, which alone
    is kept. Rows with a null doc_id or text give no row. Rows that share a doc_id share its occurrences, repeated rows each with rows of their own; text_key
    tells different texts apart. Other columns play no part.
    """
    if shortest <= threshold:
        raise ValueError("linked lines have more characters than threshold")
    lines = occurrences(docs)
    known = cut(components(cut(links(lines.where(long_enough(F.col("line"), shortest)).select("line"), threshold))).withColumnRenamed("id", "k"))
    placed = lines.select("doc_id", "text_key", "line_no", F.unhex(F.md5("line")).alias("k")).join(known, "k", "left")
    placed = placed.select("doc_id", "text_key", "line_no", F.coalesce("component", "k").alias("class"))
    # lines without a second occurrence need no partner; the others' classes are joined where a hot one can be split
    first = placed.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = placed.join(cut(first.select("class", "first")), "class", "left")
    class_doc, class_line = F.coalesce("first.doc_id", "doc_id"), F.coalesce("first.line_no", "line_no")
    kept = (F.col("doc_id") == class_doc) & (F.col("line_no") == class_line)
    return named.select("doc_id", "text_key", "line_no", class_doc.alias("class_doc"), class_line.alias("class_line"), kept.alias("kept"))


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """docs with the lines that line_classes doesn't keep removed from text; all rows and columns stay.

    A text all of whose lines go becomes empty; blank lines stay. n_chars, if docs has it, is counted anew.
    Rows with a null doc_id or text stay as they are.
    """
    gone = line_classes(docs, threshold, shortest).where("not kept").groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(F.collect_set("line_no").alias("__gone"))
    lines = F.split("text", "\n")
    left = _let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: F.get(x, i)), "\n"))
    out = docs.join(gone, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__key")), "left").withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
