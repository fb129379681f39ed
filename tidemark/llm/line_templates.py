"""Lines that recur across documents, found with a fixed-depth tree of line templates.

The tree's leaf for a line is its token count and its first LEAD tokens, where a token with a digit is
the variable <*>. Within a leaf each token is counted over the leaf's different lines. The best CONSTANT of a line's positions
give its group: the lines that agree there, of which there are as many as the least of their counts. A token is constant where at least SHARE of the group
has it, and two lines at least, whatever else is in the leaf; other tokens are variable fields. Lines with the same constants
share a template; lines whose best positions are not all shared are templates by themselves. A line with too many tokens with digits is no template: it stands for itself, with its digits. A template in two or more
documents recurs: its first line in order of documents stays, all others are dropped. Lines of fewer than
LEAST_TOKENS tokens say little and stand in many texts: they recur only as they are, in SHORT_DOCS documents or more.
Everything is DataFrame functions; only lines in leaves with more than one kind of line are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, saved, text_of

LEAD = 4
LEAST_TOKENS = 5
SHORT_DOCS = 100
SHARE = 0.8
CONSTANT = 0.75
VARIABLE = "<*>"
#: Leaves with more than one kind of line are broadcast up to so many (8 MB of hashes), and joined by a shuffle beyond.
SMALL = 1_000_000

_TOKEN = r"[^\x20\x09-\x0D]"


def _spaced(line: Column) -> Column:
    return F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]++", " ")


def _masked_line(line: Column) -> Column:
    """A line with its tokens set apart by one space and those with a digit as <*>.

    A token is cut at its first digit and then, in the reversed line, up to its other end: no pattern looks back or tries
    a token twice.
    """
    tails = F.regexp_replace(line, "[0-9]" + _TOKEN + "*+", "0")
    return _spaced(F.reverse(F.regexp_replace(F.reverse(tails), "0" + _TOKEN + "*+", VARIABLE[::-1])))


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def masked(text: Column) -> Column:
    """The text's lines in lower case, their tokens set apart by one space, those with a digit as <*>.

    A line of which less than CONSTANT would be left keeps its digits. Lines are masked in the array, before they
    are exploded, so that no filter on a line repeats it; a line with nothing to mask is only looked through.
    """
    both = lambda line: F.when(line.rlike("[0-9]"), F.array(F.trim(_masked_line(line)), F.trim(_spaced(line)))).otherwise(
        F.array(F.trim(F.when(line.rlike(r"[\x09\x0B-\x0D]|  "), _spaced(line)).otherwise(line))))
    enough = lambda x: _count(x[0], VARIABLE) / len(VARIABLE) <= (1 - CONSTANT) * (_count(x[0], " ") + 1)
    return F.transform(F.transform(F.split(text, "\n"), both), lambda x: F.lower(F.when((F.size(x) == 1) | enough(x), x[0]).otherwise(x[1])))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, line, n, leaf, kind): the lines that have a token."""
    text = text_of()
    lines = docs.select("doc_id", F.xxhash64(text).alias("h"), F.posexplode(masked(text)).alias("pos", "line")).where("line <> ''")
    leaf = F.xxhash64("n", F.substring_index("line", " ", LEAD))
    return lines.withColumn("n", _count(F.col("line"), " ") + 1).select("*", leaf.alias("leaf"), F.xxhash64("line").alias("kind"))


def recurring(lines: DataFrame) -> DataFrame:
    """(leaf, kind, first): kinds of line whose template recurs, and the line that stays.

    In a leaf with one kind of line the line is the template. Only the leaves with more are taken apart.
    """
    first = F.struct("doc_id", "h", "pos")
    long = lines.where(F.col("n") >= LEAST_TOKENS)
    kinds = long.groupBy("leaf", "kind").agg(F.min(first).alias("first"), F.max(F.struct("doc_id", "h")).alias("last"))
    kinds = saved(kinds.select("leaf", "kind", "first.*", (~F.struct("first.doc_id", "first.h").eqNullSafe(F.col("last"))).alias("apart")))
    mixed = saved(kinds.groupBy("leaf").agg(F.count("*").alias("k")).where("k > 1"))
    named = broadcast_if_small(mixed.select("leaf"), SMALL)
    plain = kinds.where("apart").join(named, "leaf", "left_anti").select("leaf", "kind", first.alias("first"))

    texts = saved(long.select("leaf", "kind", "line").join(named, "leaf", "left_semi").groupBy("leaf", "kind").agg(F.first("line").alias("line")))
    tokens = texts.select("leaf", "kind", F.posexplode(F.split("line", " ")).alias("at", "token")).where(F.col("token") != VARIABLE)
    tokens = tokens.select("leaf", "kind", F.xxhash64("leaf", "at", "token").alias("slot"))
    slots = tokens.groupBy("slot").agg(F.count("*").alias("m")).where("m > 1")
    # by request: Spark sizes the tokens by the file of lines, and would broadcast them
    counted = tokens.join(slots.select("slot", "m").hint("merge"), "slot").groupBy("leaf", "kind").agg(F.sort_array(F.collect_list(F.struct("m", "slot")), asc=False).alias("slots"))
    sizes = texts.select("leaf", "kind", F.size(F.split("line", " ")).alias("n"))
    least = F.get("slots", F.ceil(CONSTANT * F.col("n")).cast("int") - 1)["m"]
    shape = F.array_sort(F.transform(F.filter("slots", lambda s: s["m"] >= SHARE * least), lambda s: s["slot"]))
    by_itself, by_shape = F.struct(F.lit(0).alias("by"), F.col("kind").alias("hash")), F.struct(F.lit(1).alias("by"), F.xxhash64(shape).alias("hash"))
    shaped = sizes.join(counted, ["leaf", "kind"], "left").select("leaf", "kind", F.when(least.isNotNull(), by_shape).otherwise(by_itself).alias("template"))
    shaped = saved(shaped.join(kinds.hint("merge"), ["leaf", "kind"]).select("leaf", "kind", "template", first.alias("first"), "apart"))
    who = F.struct("first.doc_id", "first.h")
    groups = shaped.groupBy("leaf", "template").agg(F.min("first").alias("first"), (F.max("apart") | ~F.min(who).eqNullSafe(F.max(who))).alias("recurs")).where("recurs").drop("recurs")
    alike = shaped.select("leaf", "kind", "template").join(groups, ["leaf", "template"]).select("leaf", "kind", "first")

    short = lines.where(F.col("n") < LEAST_TOKENS).groupBy("leaf", "kind", "doc_id", "h").agg(F.min("pos").alias("pos"))
    often = short.groupBy("leaf", "kind").agg(F.min(first).alias("first"), F.count("*").alias("docs")).where(F.col("docs") >= SHORT_DOCS).drop("docs")
    return plain.unionByName(alike).unionByName(often)


def cut_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with recurring lines dropped: (doc_id, n_lines, n_cut, text) and `row`, the row as it was.

    Rows are never dropped: a document whose lines all stand elsewhere first keeps an empty text. A null text
    comes back as the empty text and an empty text has one empty line. Rows equal in doc_id and text are one document, and
    both lose the same lines. Null ids sort first. Lines without a token stay. An empty table gives no rows.
    Other columns are not looked at.
    """
    lines = saved(_lines(docs))
    stays = F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first"))
    cuts = lines.select("doc_id", "h", "pos", "leaf", "kind").join(recurring(lines), ["leaf", "kind"]).where(~stays).groupBy("doc_id", "h").agg(F.collect_set("pos").alias("cut"))
    cuts = cuts.select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), "cut")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    met = whole.join(cuts, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left")
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("cut"))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    n_cut = F.coalesce(F.size("cut"), F.lit(0))
    return met.select("row", "doc_id", F.size(parts).alias("n_lines"), F.when(n_cut < 0, 0).otherwise(n_cut).alias("n_cut"), text.alias("text"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """documents with their recurring lines dropped; n_chars, where it is there, counts the text that is left.

    Rows and odd values are treated as by cut_lines: none is dropped, a null text comes back empty, no rows give no rows.
    """
    cut = cut_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select([new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
