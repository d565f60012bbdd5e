"""Document fingerprints as Merkle trees, in DataFrame operations only.

A text is cut, without loss, into sections at blank lines and into paragraphs at line breaks.  A paragraph's hash is that
of its bytes, a section's that of its paragraphs' hashes, the root's that of its sections' hashes; so equal roots mean
equal texts and differing branches locate edits.  Below each paragraph the tree has leaves, short codes of its phrases (up
to four words of one sentence), by which two fingerprints are likened without their texts.

    root(64 hex) : section(16) { paragraph(12) ~leaf(6) ~leaf(6) | paragraph(12) ... } section(16) { ... }

A null text counts as empty and has one empty section.  Texts are handled whole, in time that grows with their length.
Likeness is 1 for equal roots, else twice the shared distinct leaves over the sum of both; 0 if there are none.  Rows with
equal doc_id follow each other by a hash of the text, equal rows are each other's next, and rows without doc_id come last.
An empty table gives no rows; a single row is its own next.  Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

#: Documents in one bucket of neighbours, and the most buckets; their boundaries are broadcast, 16 bytes each.
BUCKET_ROWS, BUCKETS = 4000, 1 << 18
#: Ids that one task sorts to find boundaries, about.
SORTED_ROWS = 1_000_000
_PHRASE = r"[^\\s.!?]+(?:[ \\t]+[^\\s.!?]+){0,3}[.!?]*|[.!?]+"


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column given by name."""
    leaf = "concat('~', right(lpad(hex(xxhash64(x)), 6, '0'), 6))"
    paragraph = f"named_struct('h', md5(cast(p as binary)), 'c', array_join(transform(regexp_extract_all(p, '{_PHRASE}', 0), x -> {leaf}), ''))"
    tree = rf"transform(split({text}, '(?<=\n)(?=[ \\t]*\n)', -1), s -> transform(split(s, '(?<=\n)', -1), p -> {paragraph}))"
    section = "named_struct('h', md5(cast(array_join(transform(ps, p -> p.h), ',') as binary)), 'c', array_join(transform(ps, p -> concat(left(p.h, 12), p.c)), '|'))"
    sections = f"transform({tree}, ps -> {section})"
    whole = "concat(sha2(cast(array_join(transform(ss, s -> s.h), ';') as binary), 256), ':', array_join(transform(ss, s -> concat(left(s.h, 16), '{', s.c, '}')), ''))"
    return F.expr(f"element_at(transform(array({sections}), ss -> {whole}), 1)")


def leaves(code: str) -> str:
    """SQL for the distinct leaves of a fingerprint."""
    return f"array_distinct(transform(slice(split({code}, '~', -1), 2, 2000000000), x -> left(x, 6)))"


def likeness(a: str, b: str) -> Column:
    """How alike two fingerprints are, 0 to 1."""
    shared = f"element_at(transform(array(named_struct('a', {leaves(a)}, 'b', {leaves(b)})), z -> coalesce(try_divide(2D * size(array_intersect(z.a, z.b)), cast(size(z.a) + size(z.b) as double)), 0D)), 1)"
    return F.expr(f"case when left({a}, 64) = left({b}, 64) then 1D else {shared} end")


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with value computed once and known as name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _upto(n: str) -> str:
    return f"filter(sequence(0, {n}), i -> i > 0)"


def _apart(x: str, y: str, body: str) -> str:
    """SQL of body, in which d.x and d.y are the positions at which the lists x and y differ.

    Equal ends are left out.  What remains between them differs place by place if both have as much left, else whole.
    """
    equal = lambda n, sign: f"transform({_upto(n)}, i -> element_at(l.x, {sign}i) = element_at(l.y, {sign}i))"
    run = lambda n, sign: _let("at", f"array_position({equal(n, sign)}, false)", f"if(at = 0, {n}, int(at) - 1)")
    between = lambda of: f"filter({_upto(f'size(l.{of}) - tail')}, i -> i > head and (size(l.x) <> size(l.y) or element_at(l.x, i) <> element_at(l.y, i)))"
    both = f"named_struct('x', {between('x')}, 'y', {between('y')})"
    return _let("l", f"named_struct('x', {x}, 'y', {y})", _let("n", "least(size(l.x), size(l.y))", _let("head", run("n", ""), _let("tail", run("n - head", "-"), _let("d", both, body)))))


def differing(a: str, b: str) -> Column:
    """(sections_a, sections_b, paragraphs_a, paragraphs_b): where the fingerprints a and b differ, by position from 1.

    Sections are numbers, paragraphs (section, paragraph) pairs within the differing sections.  A section that only b has is
    in sections_b alone, one that only a has in sections_a alone; equal roots give empty lists.  Time is linear.
    """
    sections = lambda c: f"transform(filter(split(substring({c}, 66), '[}}]', -1), s -> s <> ''), s -> named_struct('h', left(s, 16), 'p', transform(split(substring(s, 18), '[|]', -1), x -> left(x, 12))))"
    hashes = lambda of: f"transform(t.{of}, s -> s.h)"
    paragraphs = lambda of: f"flatten(transform(d.{of}, k -> transform(element_at(t.{of}, k).p, (h, m) -> named_struct('section', k, 'paragraph', m + 1, 'h', h))))"
    places = lambda of: f"transform(d.{of}, i -> named_struct('section', element_at(f.{of}, i).section, 'paragraph', element_at(f.{of}, i).paragraph))"
    found = f"named_struct('sections_a', e.x, 'sections_b', e.y, 'paragraphs_a', {places('x')}, 'paragraphs_b', {places('y')})"
    inner = _let("e", "d", _let("f", f"named_struct('x', {paragraphs('x')}, 'y', {paragraphs('y')})", _apart("transform(f.x, p -> p.h)", "transform(f.y, p -> p.h)", found)))
    return F.expr(_let("t", f"named_struct('x', {sections(a)}, 'y', {sections(b)})", _apart(hashes("x"), hashes("y"), inner)))


def with_next(docs: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Each row with the text and `extra` columns of the next in descending doc_id order, as next_<name>; the last has the first.

    Rows are dealt into buckets of neighbours, whose boundaries are exact quantiles of (doc_id, hash of text).  Only the
    last document of each bucket is copied to the next one, so texts are shuffled once and no task sorts more than a bucket,
    however ids lie.
    """
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))
    ids = docs.select(key.alias("key"))
    total = ids.count()
    rows = max(BUCKET_ROWS, -(-total // BUCKETS))
    spread = ids.repartitionByRange(max(1, -(-total // SORTED_ROWS)), "key").withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    tops = spread.withColumn("bucket", F.floor(number / rows)).groupBy("part", "bucket").agg(F.max("key").alias("top"))
    tops = common.materialise(tops.select("top").distinct(), "tops")
    level = max(1, round((total / rows) ** 0.5))
    # one row: all boundaries, the last of each `level`, and the groups of `level`
    bounds = tops.agg(F.array_sort(F.collect_list("top")).alias("tops"))
    bounds = bounds.select("tops", F.filter("tops", lambda x, i: i % level == level - 1).alias("coarse"), F.transform(F.sequence(F.lit(0), F.floor((F.size("tops") - 1) / level)), lambda j: F.slice("tops", j.cast("int") * level + 1, level)).alias("fine"))
    placed = docs.withColumns({"key": key, **extra}).crossJoin(F.broadcast(bounds))  # one row of bounded size
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("key")))
    placed = placed.withColumn("group", below(F.col("coarse"))).withColumn("bucket", F.col("group") * level + below(F.element_at("fine", F.col("group") + 1)))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    copy = F.struct(F.pmod(F.col("bucket") + 1, F.size("tops")).alias("bucket"), F.lit(True).alias("copy"))
    last = F.element_at("tops", F.col("bucket") + 1) == F.col("key")
    placed = placed.withColumn("place", F.explode(F.when(last, F.array(own, copy)).otherwise(F.array(own)))).drop("tops", "coarse", "fine", "group", "bucket")
    w = Window.partitionBy("place.bucket").orderBy("place.copy", F.desc("key"))
    return placed.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("text", *extra)}).filter("not place.copy").drop("place", "key")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit: the last third replaced by as many code points of the next document."""
    rows = common.texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(rows, {"fingerprint": fingerprint("text")})
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 3)), left(next_text, int(n_chars div 3)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint("edited").alias("edited_fingerprint"), "next_fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
        F.size(differing("edited_fingerprint", "fingerprint")["sections_a"]).cast("long").alias("differing_sections"),
    )
