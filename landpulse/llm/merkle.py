"""Merkle trees over the sections and paragraphs of alert messages, in built-in expressions only.

A text is cut, without losing a character, into sections (ended by an empty line), those into
paragraphs (ended by a line end) and those into sentences, long ones cut on. Leaves are their digests; the
digest of an inner node is taken over its children's. Roots test equality, and where roots differ
the branches that differ locate the edit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 32  # code points of a leaf
LEAF = 12  # hex digits that the written tree keeps of a leaf's digest; nodes are made of all 64


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda part: part != "")


def _node(children: Column) -> Column:
    return F.sha2(F.concat_ws(",", children), 256)


def merkle_tree(text: Column) -> Column:
    """struct(root, sections array<struct(node, paragraphs array<struct(node, leaves array<string>)>)>).

    A leaf is ``digest.length``, the length in code points. An empty text has no sections.
    """
    def leaf(sentence: Column) -> Column:
        return F.concat_ws(".", F.sha2(sentence, 256), F.length(sentence).cast("string"))

    def paragraph(part: Column) -> Column:
        return F.transform(_parts(part, f"(?<=[.!?] )|(?<=\\G(?s:.{{{LONGEST}}}))"), leaf)

    leaves = F.transform(_parts(text, "(?<=\\n\\n)"), lambda s: F.transform(_parts(s, "(?<=\\n)"), paragraph))
    paragraphs = F.transform(leaves, lambda s: F.transform(s, lambda p: F.struct(_node(p).alias("node"), p.alias("leaves"))))
    return F.transform(paragraphs, lambda s: F.struct(_node(F.transform(s, lambda p: p["node"])).alias("node"), s.alias("paragraphs")))


def tree_root(sections: Column) -> Column:
    return _node(F.transform(sections, lambda s: s["node"]))


def tree_leaves(sections: Column) -> Column:
    """All leaves in order."""
    return F.flatten(F.transform(sections, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"]))))


def tree_text(sections: Column) -> Column:
    """The tree as text: root, then sections ``/``, their paragraphs ``;`` and leaves ``,``, leaf digests
    cut to ``LEAF`` digits."""
    short = lambda x: F.concat(F.substring(x, 1, LEAF), F.substring(x, 65, 12))
    body = F.transform(sections, lambda s: F.concat_ws(";", F.transform(s["paragraphs"], lambda p: F.concat_ws(",", F.transform(p["leaves"], short)))))
    return F.concat(tree_root(sections), F.lit("="), F.concat_ws("/", body))


def likeness(left: Column, right: Column) -> Column:
    """Share of the text in common, from two leaf lists: 2 * common / (left + right), over distinct
    leaves weighted by their length; 1 for two empty lists."""
    def weight(leaves: Column) -> Column:
        lengths = F.transform(leaves, lambda x: F.substring_index(x, ".", -1).cast("double"))
        return F.aggregate(lengths, F.lit(0.0), lambda total, n: total + n)

    whole = weight(F.array_distinct(left)) + weight(F.array_distinct(right))
    return F.when(whole > 0, 2.0 * weight(F.array_intersect(left, right)) / whole).otherwise(1.0)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and not for every element of an inner lambda."""
    return F.transform(F.array(value), body)[0]


def _common_ends(left: Column, right: Column, body: Callable[[Column, Column], Column], key: Callable[[Column], Column]) -> Column:
    """``body`` of both lists without the items that they begin and end with in common."""
    def same(a: Column, b: Column) -> Column:
        wrong = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(key(x) == key(y), F.lit(False))), False)
        return F.when(wrong > 0, wrong - 1).otherwise(F.size(a)).cast("int")

    def cut(x: Column, first: Column, last: Column) -> Column:
        return F.slice(x, first + 1, F.greatest(F.size(x) - first - last, F.lit(0)))

    def without_end(rest: Column) -> Column:
        end = same(F.reverse(rest["a"]), F.reverse(rest["b"]))
        return _bound(F.struct(cut(rest["a"], F.lit(0), end).alias("a"), cut(rest["b"], F.lit(0), end).alias("b")), lambda r: body(r["a"], r["b"]))

    both = F.struct(left.alias("a"), right.alias("b"))
    return _bound(both, lambda x: _bound(same(x["a"], x["b"]), lambda first: _bound(
        F.struct(cut(x["a"], first, F.lit(0)).alias("a"), cut(x["b"], first, F.lit(0)).alias("b")), without_end)))


def _matched(left: Column, right: Column) -> Column:
    """array<struct(l, r, from, to)>: leaves of two lists with equal keys, the k-th of a key with the k-th;
    ``l`` and ``r`` are places in the lists, NULL where a leaf has no partner. One sort of both lists."""
    def groups(mixed: Column, starts: Column) -> Column:
        ends = F.transform(starts, lambda s, j: F.slice(mixed, s + 1, F.coalesce(F.get(starts, j + 1), F.size(mixed)) - s))
        sides = F.transform(ends, lambda g: F.struct(F.filter(g, lambda x: x["side"] == 0).alias("l"), F.filter(g, lambda x: x["side"] == 1).alias("r")))
        return F.flatten(F.transform(sides, lambda g: F.zip_with(g["l"], g["r"], lambda a, b: F.struct(a["at"].alias("l"), b["at"].alias("r")))))

    def entries(items: Column, side: int) -> Column:
        return F.transform(items, lambda x, i: F.struct(x["key"].alias("key"), F.lit(side).alias("side"), i.alias("at")))

    return _bound(F.sort_array(F.concat(entries(left, 0), entries(right, 1))), lambda m: _bound(
        F.filter(F.transform(m, lambda _, i: i), lambda i: (i == 0) | (F.get(m, i - 1)["key"] != F.get(m, i)["key"])), lambda starts: groups(m, starts)))


def _edits(left: Column, right: Column) -> Column:
    """array<struct(kind, before, after)> of two lists of leaves (key, place); see ``changed_branches``."""
    def named(kind: str) -> Callable[[Column], Column]:
        return lambda p: F.struct(F.lit(kind).alias("kind"), F.get(left, p["l"])["place"].alias("before"), F.get(right, p["r"])["place"].alias("after"))

    def moves(pairs: Column) -> Column:
        by_left = F.transform(F.sort_array(F.filter(pairs, lambda p: p["l"].isNotNull() & p["r"].isNotNull())), lambda p, i: F.struct(p["r"].alias("r"), i.alias("i"), p["l"].alias("l")))
        by_right = F.sort_array(F.transform(F.sort_array(by_left), lambda p, j: F.struct(p["i"].alias("i"), (j - p["i"]).alias("shift"), p["l"].alias("l"), p["r"].alias("r"))))

        def outside(rows: Column, starts: Column) -> Column:
            lengths = F.transform(starts, lambda s, j: F.struct((F.coalesce(F.get(starts, j + 1), F.size(rows)) - s).alias("n"), (-s).alias("s")))
            return _bound(F.array_max(lengths), lambda run: F.filter(rows, lambda p: (p["i"] < -run["s"]) | (p["i"] >= run["n"] - run["s"])))

        return _bound(by_right, lambda rows: _bound(
            F.filter(F.transform(rows, lambda _, i: i), lambda i: (i == 0) | (F.get(rows, i - 1)["shift"] != F.get(rows, i)["shift"])), lambda starts: outside(rows, starts)))

    def all_of(pairs: Column) -> Column:
        removed = F.transform(F.sort_array(F.filter(pairs, lambda p: p["r"].isNull())), named("removed"))
        added = F.transform(F.sort_array(F.filter(pairs, lambda p: p["l"].isNull())), named("added"))
        return F.concat(removed, added, F.coalesce(F.transform(moves(pairs), named("moved")), F.array().cast(EDITS)))

    return _bound(_matched(left, right), all_of)


PLACE = "struct<section:int,paragraph:int,leaf:int>"
EDITS = f"array<struct<kind:string,before:{PLACE},after:{PLACE}>>"


def changed_branches(left: Column, right: Column) -> Column:
    """Where the text of tree ``right`` differs from that of ``left``: array<struct(kind, before, after)>.

    ``before`` and ``after`` are places struct(section, paragraph, leaf), from 0, in either text. A leaf is
    ``removed`` (no ``after``), ``added`` (no ``before``) or ``moved``. Both trees are walked from the root:
    sections, then paragraphs, that both begin or end with, told by their digests, are passed over whole,
    and so are leaves. Of what is left, the k-th leaf with a digest belongs to the k-th one with it on the
    other side. Leaves without a partner were removed or added; the longest run of partners that follow
    each other on both sides stays in place (the first of equally long ones), other partners were moved.
    Equal texts have no edits, and texts that differ have one at least.
    """
    def paragraphs(sections: Column) -> Column:
        return F.flatten(F.transform(sections, lambda s: F.transform(s["item"]["paragraphs"], lambda p, j: F.struct(
            p["node"].alias("key"), s["at"].alias("section"), j.alias("paragraph"), p["leaves"].alias("leaves")))))

    def leaves(rows: Column) -> Column:
        return F.flatten(F.transform(rows, lambda p: F.transform(p["leaves"], lambda x, k: F.struct(x.alias("key"), F.struct(
            p["section"].alias("section"), p["paragraph"].alias("paragraph"), k.alias("leaf")).alias("place")))))

    key = lambda x: x["key"]
    placed = [F.transform(t, lambda s, i: F.struct(s["node"].alias("key"), i.alias("at"), s.alias("item"))) for t in (left, right)]
    return _common_ends(*placed, lambda a, b: _common_ends(paragraphs(a), paragraphs(b), lambda c, d: _common_ends(leaves(c), leaves(d), _edits, key), key), key)


def fingerprint_messages(alerts: DataFrame, id_column: str = "alert_id", message: str = "message_body") -> DataFrame:
    """(alert_id, n_chars, tree, fingerprint) of every alert. A NULL message is empty. Rows with NULL
    or repeated ids are kept one by one; messages are taken whole; other columns are ignored; an empty
    table stays empty."""
    text = F.coalesce(F.col(message), F.lit(""))
    rows = alerts.select(F.col(id_column).alias("alert_id"), F.length(text).cast("long").alias("n_chars"), merkle_tree(text).alias("tree"))
    return rows.withColumn("fingerprint", tree_text(F.col("tree")))


def _bucket(key: Column, cuts: list) -> Column:
    """Number of cuts at or below ``key``, in about 2 * sqrt(cuts) comparisons a row."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    fine = F.array(*[F.lit(c) for c in cuts])
    coarse = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[::step]]), lambda c: c <= key))
    inside = F.size(F.filter(F.slice(fine, (F.greatest(coarse, F.lit(1)) - 1) * step + 1, F.lit(step)), lambda c: c <= key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + inside)


def compare_with_successor(alerts: DataFrame, share: int = 3, id_column: str = "alert_id", message: str = "message_body",
                           buckets: int | None = None) -> DataFrame:
    """Every alert's fingerprint next to that of its edited message and of the alert after it.

    The alert after it is the next in descending id order; the first follows the last. In the
    edited message the last ``n_chars // share`` code points are replaced by as many (or all) of the
    next message's first. Returns (alert_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edit_places: what ``changed_branches`` finds in the edited message).

    Ids are cut into ``buckets`` ranges (by default four per shuffle partition) and every range also
    gets a copy of the first row of the range after it, so neighbours are found inside ranges, in one
    shuffle. NULL messages are empty. NULL ids come last; equal ids are ordered by a hash of the
    message (ids are keys: rows that repeat one stay in one range). Other columns are ignored; an
    empty table stays empty.
    """
    spark = alerts.sparkSession
    wanted = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(message), F.lit(""))
    rows = alerts.select(F.col(id_column).alias("alert_id"), text.alias("_text"))
    id_type = rows.schema["alert_id"].dataType
    if isinstance(id_type, T.NumericType):
        cuts = sorted(set(rows.stat.approxQuantile("alert_id", [i / wanted for i in range(1, wanted)], 0.2 / wanted)))  # at most `wanted` numbers
        place = _bucket(F.col("alert_id").cast("double"), cuts)
    else:  # about 16 sampled ids a range
        known = rows.where("alert_id IS NOT NULL").select("alert_id")
        sample = sorted(r[0] for r in known.sample(min(1.0, 16 * wanted / max(1, known.count())), seed=7).collect())
        place = _bucket(F.col("alert_id"), sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)} if sample else ()))
    placed = rows.withColumn("_bucket", F.when(F.col("alert_id").isNull(), -1).otherwise(place))
    rank = F.struct("alert_id", F.xxhash64("_text"))
    heads = placed.groupBy("_bucket").agg(F.max_by("_text", rank).alias("_text"), F.max("_bucket").alias("_at"))
    by_bucket = Window.orderBy(F.desc("_bucket"))  # one row per bucket, keys only
    keys = placed.select("_bucket").distinct()
    chain = keys.select("_bucket", F.coalesce(F.lead("_bucket").over(by_bucket), F.first("_bucket").over(by_bucket)).alias("_next"))
    guests = chain.join(heads.select(F.col("_at").alias("_next"), "_text"), "_next").select(
        F.lit(None).cast(id_type).alias("alert_id"), "_text", "_bucket", F.lit(1).alias("_guest"))
    together = placed.select("alert_id", "_text", "_bucket", F.lit(0).alias("_guest")).unionByName(guests)
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc_nulls_last("alert_id"), F.desc(F.xxhash64("_text")))
    # trees are grown behind the shuffle, which then carries the messages alone
    treed = together.repartition("_bucket").withColumn("_tree", merkle_tree(F.col("_text")))
    paired = (treed.withColumns({"_next_text": F.lead("_text").over(order), "_next_tree": F.lead("_tree").over(order)})
              .where("_guest = 0"))
    n = F.length("_text").cast("long")
    tail = F.floor(n / F.lit(share)).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), (n - tail).cast("int")), F.substring("_next_text", F.lit(1), tail))
    made = paired.select("alert_id", n.alias("n_chars"), "_tree", "_next_tree", edited.alias("_edited"))
    made = made.select("alert_id", "n_chars", "_tree", "_next_tree", F.sha2("_edited", 256).alias("edited_sha256"),
                       merkle_tree(F.col("_edited")).alias("_edited_tree"))
    made = made.withColumns({"_leaves": tree_leaves(F.col("_tree")), "_edited_leaves": tree_leaves(F.col("_edited_tree"))})
    return made.select(
        "alert_id", "n_chars", "edited_sha256", tree_text(F.col("_tree")).alias("fingerprint"),
        tree_text(F.col("_edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("_leaves"), F.col("_edited_leaves")).alias("near_edited"),
        likeness(F.col("_leaves"), tree_leaves(F.col("_next_tree"))).alias("near_next"),
        changed_branches(F.col("_tree"), F.col("_edited_tree")).alias("edit_places"))
