"""Pages, images and content streams of PDF files, asked of the rows of ``pdf_objects``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.plans.scratch import stored
from folioflow.sources.pdf_objects import pdf_objects

#: Attributes that a page has from the nodes above it where it has none itself.
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


def entry(key: str) -> Column:
    return F.element_at("entries", key)


def refers_to(value: Column) -> Column:
    """The number of the object that a value refers to; null for other values."""
    return F.when(value.rlike(r"^\d+ \d+ R$"), F.regexp_extract(value, r"^(\d+)", 1).cast("int"))


def image_objects(files: DataFrame) -> DataFrame:
    """A row per image object of files (path, content): path, num, gen, width, height, bpc, is_mask, filter, length, bilevel.

    Missing bits per component count as 8, a missing mask flag as false, other missing numbers as 0. An object is bilevel
    with one bit and no mask. Numbers that are objects of their own are followed.
    """
    objects = stored(pdf_objects(files), "pdf-objects")
    images = objects.where(entry("Subtype") == "/Image")
    keys = ("Width", "Height", "BitsPerComponent", "Length")
    values = objects.select("path", F.col("num").alias("ref"), F.col("value").try_cast("int").alias("n"))
    named = images.select("path", "num", "gen", "entries", *(entry(k).alias(k) for k in keys))
    for k in keys:
        named = named.withColumn("ref", refers_to(F.col(k))).join(values, ["path", "ref"], "left").withColumn(k, F.coalesce(F.col(k).try_cast("int"), "n")).drop("ref", "n")
    filter_ = F.regexp_extract(F.coalesce(entry("Filter"), F.lit("")), r"/(\w+)", 1)
    rows = named.select("path", "num", "gen", F.coalesce("Width", F.lit(0)).alias("width"), F.coalesce("Height", F.lit(0)).alias("height"), F.coalesce("BitsPerComponent", F.lit(8)).alias("bpc"), F.coalesce(entry("ImageMask") == "true", F.lit(False)).alias("is_mask"), filter_.alias("filter"), F.coalesce("Length", F.lit(0)).alias("length"))
    return rows.withColumn("bilevel", (F.col("bpc") == 1) & ~F.col("is_mask"))


def page_counts(files: DataFrame) -> DataFrame:
    """path, pages and has_font; a file that is no PDF, or is encrypted, has an error instead."""
    keys = F.map_keys(F.coalesce("entries", F.create_map().cast("map<string,string>")))
    font = F.exists(keys, lambda k: k.rlike(r"(^|/)Font(/|$)")) | F.coalesce(entry("Type") == "/Font", F.lit(False))
    found = pdf_objects(files).groupBy("path").agg(F.count_if(entry("Type") == "/Page").alias("n"), F.bool_or(font).alias("f"), F.min("error").alias("error"))
    wrong = F.coalesce(F.col("error").isin("not a PDF", "encrypted"), F.lit(False))
    return found.select("path", F.when(~wrong, F.col("n")).alias("pages"), F.when(~wrong, F.col("f")).alias("has_font"), F.when(wrong, F.col("error")).alias("error"))


def page_nodes(objects: DataFrame) -> DataFrame:
    """A row per page in document order: path, page_no (from 1), num, entries and inherited, of stored ``pdf_objects`` rows.

    A node of the page tree knows the one above it; every round each node takes over what is above its known ancestor, so the
    rounds double and a tree of any depth needs few of them. Nodes that the root does not reach, circles among them,
    give no pages; a page that is listed twice is two pages.
    """
    kids = F.regexp_extract_all(F.coalesce(entry("Kids"), F.lit("")), F.lit(r"(\d+) \d+ R"), F.lit(1))
    own = F.map_filter("entries", lambda k, _: F.regexp_extract(k, r"^([^/]*)", 1).isin(*INHERITED))
    nodes = objects.where(F.col("num") > 0).select("path", "num", "entries", own.alias("own"), kids.alias("kids"), ((entry("Type") == "/Page") | (entry("Type").isNull() & entry("Kids").isNull())).alias("leaf"))
    catalog = objects.where("num = 0").select("path", refers_to(entry("Root")).alias("num"))
    listed = objects.join(catalog, ["path", "num"]).select("path", refers_to(entry("Pages")).alias("num"))
    # The catalog's entry, or the one page tree node that has none above it.
    heads = objects.where((entry("Type") == "/Pages") & entry("Parent").isNull()).groupBy("path").agg(F.min("num").alias("other"))
    roots = listed.join(heads, "path", "full").select("path", F.coalesce("num", "other").alias("num")).where("num is not null")
    none = F.lit(None).cast("int")
    below = nodes.select("path", F.col("num").alias("up"), F.posexplode("kids").alias("at", "kid")).select("path", F.col("kid").cast("int").alias("num"), "up", F.array("at").alias("place"))
    walk = below.join(roots, ["path", "num"], "left_anti").unionByName(roots.select("path", "num", none.alias("up"), F.array().cast("array<int>").alias("place")))
    sizes = nodes.groupBy("path").agg(F.count("*").alias("n"))
    walk = stored(walk.join(nodes.select("path", "num", "own"), ["path", "num"]), "pdf-tree")
    while not walk.where("up is not null").isEmpty():
        above = walk.select("path", F.col("num").alias("up"), F.col("up").alias("next"), F.col("place").alias("before"), F.col("own").alias("theirs"))
        risen = walk.where("up is not null").join(above, ["path", "up"]).join(sizes, "path").where(F.size("before") + F.size("place") <= F.col("n"))
        # An attribute of a node hides all that is above it under that name.
        lacking = F.map_filter("theirs", lambda k, _: ~F.array_contains(F.transform(F.map_keys("own"), lambda o: F.regexp_extract(o, r"^([^/]*)", 1)), F.regexp_extract(k, r"^([^/]*)", 1)))
        moved = risen.select("path", "num", F.col("next").alias("up"), F.concat("before", "place").alias("place"), F.map_concat("own", lacking).alias("own"))
        walk = stored(walk.where("up is null").unionByName(moved), "pdf-tree")
    turn = F.row_number().over(Window.partitionBy("path").orderBy("place"))  # one file's pages
    pages = walk.join(nodes.where("leaf").select("path", "num", "entries"), ["path", "num"])
    return pages.select("path", turn.cast("bigint").alias("page_no"), "num", "entries", F.col("own").alias("inherited"))


def page_rows(files: DataFrame) -> DataFrame:
    """A row per page in document order: path, page_no (from 1), num of its object, its media box or null, its turn in degrees.

    Box and turn are the page's own or those of the nearest node above it.
    """
    pages = page_nodes(stored(pdf_objects(files), "pdf-objects"))
    box = F.trim(F.translate(F.element_at("inherited", "MediaBox"), "[]", ""))
    return pages.select("path", "page_no", "num", box.alias("box"), F.coalesce(F.element_at("inherited", "Rotate").try_cast("int"), F.lit(0)).alias("turn"))


def page_images(files: DataFrame) -> DataFrame:
    """A row per image name of a page's resources: path, page_no, name and num of the image object.

    Resources, and the list of objects in them, are the page's or those above it, in place or objects of their own.
    """
    objects = stored(pdf_objects(files), "pdf-objects")
    pages = page_nodes(objects).select("path", "page_no", "inherited")
    others = objects.select("path", F.col("num").alias("ref"), F.col("entries").alias("there"))
    named = pages.select("path", "page_no", F.explode("inherited").alias("key", "value")).where(F.col("key").startswith("Resources"))
    # Two lists at most stand between a page and an image: its resources and their named objects.
    for stop in ("Resources", "Resources/XObject"):
        reached = named.withColumn("ref", F.when(F.col("key") == stop, refers_to(F.col("value"))))
        followed = reached.where("ref is not null").join(others, ["path", "ref"]).select("path", "page_no", F.lit(stop).alias("stop"), F.explode("there").alias("k", "value"))
        named = reached.where("ref is null").select("path", "page_no", "key", "value").unionByName(followed.select("path", "page_no", F.concat_ws("/", "stop", "k").alias("key"), "value"))
    found = named.where(F.col("key").rlike("^Resources/XObject/[^/]+$")).select("path", "page_no", F.regexp_extract("key", "([^/]+)$", 1).alias("name"), refers_to(F.col("value")).alias("num"))
    images = objects.where(entry("Subtype") == "/Image").select("path", "num")
    return found.join(images, ["path", "num"]).select("path", "page_no", "name", "num")


def page_contents(files: DataFrame) -> DataFrame:
    """path, page_no and content: a page's content streams in order, a line feed between them, as text of one byte a character.

    Null where a stream is missing or stored by a filter other than Flate; empty for a page without content.
    """
    objects = stored(pdf_objects(files), "pdf-objects")
    pages = page_nodes(objects).select("path", "page_no", F.coalesce(entry("Contents"), F.lit("")).alias("contents"))
    # A reference may name an array of references.
    arrays = objects.where(F.col("value").startswith("[")).select("path", F.col("num").alias("ref"), F.col("value").alias("listed"))
    pages = pages.withColumn("ref", refers_to(F.col("contents"))).join(arrays, ["path", "ref"], "left").select("path", "page_no", F.coalesce("listed", "contents").alias("contents"))
    refs = F.regexp_extract_all("contents", F.lit(r"(\d+) \d+ R"), F.lit(1))
    each = pages.select("path", "page_no", F.posexplode_outer(refs).alias("at", "ref")).withColumn("ref", F.col("ref").cast("int"))
    streams = objects.select("path", F.col("num").alias("ref"), F.decode("stream", "ISO-8859-1").alias("text"))
    parts = each.join(streams, ["path", "ref"], "left").groupBy("path", "page_no").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"), F.count_if(F.col("at").isNotNull() & F.col("text").isNull()).alias("lost"))
    return parts.select("path", "page_no", F.when(F.col("lost") == 0, F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("content"))
