"""Document metadata: info fields, outline, annotations, attachments, counts, and copies of cyclic graphs."""

from __future__ import annotations

from xml.dom import minidom
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstrata.plans.lineage import cut

#: Document information fields, in the order in which they are copied (fixed values).
INFO_FIELDS = ("title", "author", "subject", "keywords", "creator", "producer")


#: Digits of an ordinal in an outline path: those of the largest int, so that paths sort as ordinals do.
DIGITS = 10


def producer_chain(existing: Column, producer: Column) -> Column:
    """``existing -> producer``; producer alone where there is none or it is blank."""
    return F.when(existing.isNull() | (F.trim(existing) == ""), producer).otherwise(F.concat(existing, F.lit(" -> "), producer))


def doc_info(pages: DataFrame) -> DataFrame:
    """Info fields of html documents; fields that a document lacks stay null."""
    first = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    return pages.select(
        F.col("page_id").alias("doc_id"),
        first("<title>([^<]*)</title>").alias("title"),
        first('<meta name="author" content="([^"]*)"').alias("author"),
        first("<h1>([^<]*)</h1>").alias("subject"),
        first('<html lang="([^"]*)"').alias("keywords"),
        first("&copy; ([^ ]*) ").alias("creator"),
        F.when(F.col("page_id") % 3 == 0, F.lit(None)).when(F.col("page_id") % 3 == 1, F.lit("  ")).otherwise(F.regexp_extract("url", "^https?://([^/?#]*)", 1)).alias("producer"),
    )


def fields_set(info: DataFrame) -> DataFrame:
    """doc_id and each field that is set, as rows: what a copy carries over."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in INFO_FIELDS])
    return info.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", "f.value").where("value IS NOT NULL")


def links(pages: DataFrame) -> DataFrame:
    """doc_id, ordinal (from 0), uri of each anchor."""
    at = F.posexplode(F.expr("regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)")).alias("ordinal", "uri")
    return pages.select(F.col("page_id").alias("doc_id"), at)


def annotations(pages: DataFrame) -> DataFrame:
    """Link annotations of each page with their attributes, the reference to the page (key P) dropped: two links a page."""
    attrs = F.create_map(F.lit("P"), F.col("doc_id").cast("string"), F.lit("Subtype"), F.lit("Link"), F.lit("URI"), F.col("uri"))
    return links(pages).select("doc_id", F.expr("ordinal div 2").cast("int").alias("page_no"), "ordinal", F.lit("Link").alias("subtype"), F.map_filter(attrs, lambda k, _: k != "P").alias("attrs"))


def copied_annotations(notes: DataFrame, source: DataFrame, output: DataFrame) -> DataFrame:
    """``notes`` on the pages that source and output both have: up to the smaller of the two counts (doc_id, n_pages)."""
    both = source.join(output.select("doc_id", F.col("n_pages").alias("n_out")), "doc_id").select("doc_id", F.least("n_pages", "n_out").alias("_n"))
    return notes.join(both, "doc_id").where(F.col("page_no") < F.col("_n")).drop("_n")


def attachments(pages: DataFrame) -> DataFrame:
    """Style and script bodies as embedded files."""
    part = lambda tag: F.transform(F.expr(f"regexp_extract_all(html, '<{tag}>(.*?)</{tag}>', 1)"), lambda c, i: F.struct(F.concat(F.lit(f"{tag}-"), i).alias("name"), F.lit(tag).alias("subtype"), c.cast("binary").alias("content")))
    both = F.explode(F.concat(part("style"), part("script"))).alias("f")
    return pages.select(F.col("page_id").alias("doc_id"), both).select("doc_id", "f.name", "f.subtype", "f.content")


def outline_items(pages: DataFrame) -> DataFrame:
    """Outline as adjacency: the heading is item 0, anchors hang below as a binary tree in order."""
    top = pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("item_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.expr("nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '')").alias("title"), F.lit(0).alias("dest_page"))
    below = links(pages).selectExpr("doc_id", "ordinal + 1 AS item_id", "CAST(ordinal div 2 AS INT) AS parent_id", "ordinal % 2 AS ordinal", "substring(uri, 2) AS title", "length(uri) % 8 AS dest_page")
    return top.unionByName(below)


def outline_tree(items: DataFrame) -> DataFrame:
    """doc_id, item_id, depth, path (ordinals from the top), title ('' for none): the order in which items are rebuilt.

    Levels are joined one at a time until none is left; a tree's depth bounds the rounds.
    """
    titled = items.withColumn("title", F.coalesce("title", F.lit("")))
    level = titled.where("parent_id IS NULL").select("doc_id", "item_id", F.lit(0).alias("depth"), F.lpad(F.col("ordinal").cast("string"), DIGITS, "0").alias("path"), "title")
    child = titled.where("parent_id IS NOT NULL").select("doc_id", F.col("item_id").alias("c_id"), "parent_id", "ordinal", F.col("title").alias("c_title"))
    found = [level]
    while True:
        level = cut(
            level.select("doc_id", F.col("item_id").alias("parent_id"), "depth", "path").join(child, ["doc_id", "parent_id"]).select(
                "doc_id", F.col("c_id").alias("item_id"), (F.col("depth") + 1).alias("depth"),
                F.concat("path", F.lit("/"), F.lpad(F.col("ordinal").cast("string"), DIGITS, "0")).alias("path"), F.col("c_title").alias("title"),
            )
        )
        if level.isEmpty():
            break
        found.append(level)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def page_counts(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages: five paragraphs a page, one page at least."""
    return pages.selectExpr("page_id AS doc_id", "CAST(greatest(1, ceil(size(regexp_extract_all(html, '<p>', 0)) / 5)) AS INT) AS n_pages")


def outline_destinations(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Each item with the output page of its destination; unresolvable ones keep the item and lose the destination."""
    at = F.when(F.col("dest_page") < F.col("n_pages"), F.col("dest_page"))
    return items.join(counts, "doc_id", "left").select("doc_id", "item_id", at.alias("dest_page"))


def preserve_counts(pages: DataFrame) -> DataFrame:
    """Per document: top-level bookmarks, all annotations, embedded files."""
    top = outline_items(pages).groupBy("doc_id").agg(F.count_if(F.col("parent_id").isNull() & F.col("title").isNotNull()).alias("outlines"))
    notes = links(pages).groupBy("doc_id").agg(F.count("*").alias("annotations"))
    files = attachments(pages).groupBy("doc_id").agg(F.count("*").alias("embedded_files"))
    return top.join(notes, "doc_id", "left").join(files, "doc_id", "left").select("doc_id", "outlines", F.coalesce("annotations", F.lit(0)).cast("long").alias("annotations"), F.coalesce("embedded_files", F.lit(0)).cast("long").alias("embedded_files"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of all nodes that a copy from each root visits once, cycles or not.

    ``edges`` has src and dst, ``roots`` has root. See copy_graph().
    """
    start = roots.select(F.col("root").alias("doc_id"), F.col("root").alias("node"), F.lit("node").alias("kind")).distinct()
    step = edges.select("src", "dst", F.lit("node").alias("dst_kind"))
    return _visited(step, start, False).select(F.col("doc_id").alias("root"), "node")


def _visited(edges: DataFrame, start: DataFrame, local: bool) -> DataFrame:
    """(doc_id, node, kind) in reach of ``start``, by rounds: the frontier is joined, deduplicated and cleared of what
    earlier rounds visited, until it is empty. Rounds are written apart, so that none is written twice."""
    frontier = cut(start)
    rounds = [frontier]
    step = edges.withColumnRenamed("src", "node")
    keys = ["doc_id", "node"] if local else ["node"]
    while True:
        new = frontier.select("doc_id", "node").distinct().join(step, keys).select("doc_id", F.col("dst").alias("node"), F.col("dst_kind").alias("kind")).distinct()
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        frontier = cut(new.join(seen, ["doc_id", "node", "kind"], "left_anti"))
        if frontier.isEmpty():
            return seen
        rounds.append(frontier)


def copy_graph(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Deep copies inside documents: doc_id, node, kind, value of each copy that the roots (doc_id, node, kind) lead to.

    ``nodes`` has doc_id, node, kind and value, ``edges`` doc_id, src, dst and dst_kind, the
    kind as which the source refers to the target. A node is copied once for each kind it is
    referred to as, cycles or not: an earlier copy of another kind doesn't serve.
    """
    seen = _visited(edges, roots.distinct(), True)
    return seen.join(nodes.select("doc_id", "node", "value"), ["doc_id", "node"])


def link_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a cyclic graph over each document's anchors: every anchor refers to two others by a rule on its text."""
    at = links(pages).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    kind = "element_at(array('dictionary', 'array', 'stream'), CAST(({0}) % 3 AS INT) + 1)"
    nodes = at.selectExpr("doc_id", "CAST(ordinal AS INT) AS node", f"{kind.format('ordinal')} AS kind", "uri AS value")
    refer = "array(struct(CAST((ordinal * 31 + length(uri)) % n AS INT) AS dst, 0 AS k), struct(CAST((ordinal + 1) % n AS INT) AS dst, length(uri) AS k))"
    edges = at.selectExpr("doc_id", "CAST(ordinal AS INT) AS src", f"inline({refer})")
    return nodes, edges.selectExpr("doc_id", "src", "dst", f"{kind.format('dst + k div 5')} AS dst_kind").distinct()


#: What PDF/A-2b identification says, and the public marks of an XMP packet (fixed values).
PDFA_PART, PDFA_CONFORMANCE = "2", "B"
PDFA, RDF = "http://www.aiim.org/pdfa/ns/id/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XMP_OPEN = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}">'
XMP_CLOSE = "</rdf:RDF></x:xmpmeta>"
PACKET_BEGIN, PACKET_END = '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n', '\n<?xpacket end="w"?>'


def static_packet() -> str:
    """The packet of a document that has none, or none that can be read."""
    own = f'<rdf:Description rdf:about="" xmlns:pdfaid="{PDFA}"><pdfaid:part>{PDFA_PART}</pdfaid:part><pdfaid:conformance>{PDFA_CONFORMANCE}</pdfaid:conformance></rdf:Description>'
    kind = '<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:format>application/pdf</dc:format></rdf:Description>'
    return PACKET_BEGIN + XMP_OPEN + own + kind + XMP_CLOSE + PACKET_END


def identified(xmp: str | None) -> str:
    """An XMP packet with part and conformance in its first Description, each added only where the packet has none.

    A null packet, or one that isn't well-formed, gives way to the static one; text without
    the element's marks stays as it is.
    """
    if xmp is None:
        return static_packet()
    start, end = xmp.find("<x:xmpmeta"), xmp.rfind("</x:xmpmeta>")
    if start < 0 or end <= start:
        return xmp
    try:
        doc = minidom.parseString(xmp[start : end + len("</x:xmpmeta>")].encode())
    except ExpatError:
        return static_packet()
    found = doc.getElementsByTagNameNS(RDF, "Description")
    if found:
        found[0].setAttributeNS("http://www.w3.org/2000/xmlns/", "xmlns:pdfaid", PDFA)
        for name, value in (("part", PDFA_PART), ("conformance", PDFA_CONFORMANCE)):
            if not doc.getElementsByTagNameNS(PDFA, name):
                element = doc.createElementNS(PDFA, f"pdfaid:{name}")
                element.appendChild(doc.createTextNode(value))
                found[0].appendChild(element)
    return PACKET_BEGIN + doc.documentElement.toxml() + PACKET_END


def pdfa_identification(packets: DataFrame) -> DataFrame:
    """doc_id and xmp of ``packets`` (the same columns; xmp a string or null) after identified(), in Arrow batches."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(list(map(identified, b.column(1).to_pylist())), pa.string())], names=["doc_id", "xmp"])

    rows = packets.select("doc_id", "xmp")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, xmp string")
