"""The registered queries: every operator applied to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import text as T
from folioflow.operators import colour, content, glyphs, health, jobs, raster, selection, tiles
from folioflow.operators.scans import ordinals
from folioflow.plans import assembly, stages
from folioflow.plans.closure import closure
from folioflow.plans.scratch import stored
from folioflow.sources import files, streams, views
from folioflow.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def book_manifest(spark, sf):
    pages = views.document_pages(spark, sf)
    return assembly.manifest(pages, "book", "page_no", "bytes")


@query
def numbering_mode(spark, sf):
    """Half the conversations get repeated numbers and fall back to positions."""
    lines = views.recognised_lines(spark, sf)
    number = F.when(F.col("doc") % 2 == 0, F.floor(F.col("page") / 2)).otherwise(F.col("page"))
    names = lines.select("doc", F.concat("role", F.lit("_"), number.cast("string"), F.lit(".jpg")).alias("name")).distinct()
    found = selection.number_pages(names, "doc", "name")
    return found.select("doc", "name", "numbered", "page_no")


@query
def page_filter(spark, sf):
    pages = views.document_pages(spark, sf)
    include = views.read(spark, sf, "labels").select("doc_id")
    exclude = views.read(spark, sf, "labels").where("toxic = 1").select("doc_id")
    kept = selection.select_pages(pages, "page_no", include, exclude, (3, None))
    return kept.where(T.is_page_image(F.col("fname"))).select("book", "page_no", "bytes")


@query
def parse_ranges(spark, sf):
    """Specs made of each region's key."""
    key = F.col("r_regionkey")
    specs = views.read(spark, sf, "region").select(F.explode(F.array(F.format_string("%d,7,%d-%d", key, key + 2, key + 5), F.format_string(" %d , ,4", key), F.format_string("10-%d", key), F.format_string("-%d,%d", key + 1, key), F.lit(""))).alias("spec"))
    return specs.distinct().select("spec", F.array_join(F.transform(T.parse_ranges(F.col("spec")), lambda x: x.cast("string")), ",").alias("numbers"))


@query
def cover_split(spark, sf):
    pages = views.document_pages(spark, sf)
    return selection.mark_covers(pages, "book", "page_no", chosen=F.col("page_no") % 100 == 50).groupBy("book", "is_cover").agg(F.count("*").alias("pages"), F.sum("bytes").cast("bigint").alias("bytes"))


@query
def chunk_plan(spark, sf):
    rows = assembly.chunked(views.document_pages(spark, sf), "book", "page_no")
    return rows.groupBy("book", "chunk", "k", "per").agg(F.count("*").alias("pages"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query
def shuffled_chunks(spark, sf):
    """Pages dealt to chunks in the order of a hash of their names: a number whose span says nothing of the rows."""
    key = F.conv(F.substring(F.md5("fname"), 1, 13), 16, 10).cast("bigint")
    pages = views.document_pages(spark, sf).withColumn("key", key)
    return assembly.chunked(pages, "book", "key", width=None).select("book", "page_no", "ord", "n", "chunk")


@query
def ordered_interleave(spark, sf):
    return assembly.interleave(views.document_pages(spark, sf), "book", "page_no").select("book", "page_no", "ord", "doc", "idx")


@query
def missing_pages(spark, sf):
    docs, labels = (views.read(spark, sf, t) for t in ("documents", "labels"))
    return assembly.missing(docs.select("doc_id", "source"), labels, "doc_id")


@query
def state_merge(spark, sf):
    old = views.read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("value"))
    new = views.read(spark, sf, "labels").select("doc_id", (F.col("quality") + 10).alias("value"))
    return assembly.merge_state(old, new, "doc_id", "value")


@query
def replace_if_smaller(spark, sf):
    rows = views.line_images(spark, sf)
    made = F.when(F.col("bilevel") & F.col("decoded"), F.col("made"))
    kept = rows.withColumn("kept", assembly.replace_if_smaller(F.col("raw"), made))
    return kept.groupBy("doc").agg(F.sum("raw").alias("before"), F.sum("kept").alias("after"), F.count_if(F.col("kept") < F.col("raw")).alias("replaced"))


@query
def layer_align(spark, sf):
    """Each raster's quarters as layers, put side by side by slot; names M0 to M3 and the colour each one draws in."""
    rows = views.vector_rasters(spark, sf).select("vec_id", F.posexplode("gray").alias("at", "g"))
    layers = rows.groupBy("vec_id", F.floor(F.col("at") / 16).cast("int").alias("slot")).agg(F.sum("g").alias("ink"))
    # Slot 0 is black, slot i draws in colour i - 1; absent colours are black.
    palette = F.array(F.lit("red"), F.lit("green"))
    colour_ = F.when(F.col("slot") == 0, "black").otherwise(F.coalesce(F.try_element_at(palette, F.greatest(F.col("slot"), F.lit(1))), F.lit("black")))
    named = layers.withColumn("name", F.concat(F.lit("M"), F.col("slot").cast("string"))).withColumn("colour", colour_)
    pick = lambda c: [F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}_{i}") for i in range(4)]
    return named.groupBy("vec_id").agg(*pick("ink"), *pick("name"), *pick("colour"))


@query
def probe_grid(spark, sf):
    sample = selection.stride_sample(views.document_pages(spark, sf), "book", "page_no", 8)
    # Six cells, each sampled page once in every one.
    cells = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(q).alias("quality")) for w in (1200, 1800, 2400) for q in (45, 60)))
    each = sample.withColumn("cell", F.explode(cells)).select("book", "bytes", "n_pages", "cell.*").withColumn("made", F.expr("bytes * width * quality div 240000"))
    rows = each.groupBy("book", "width", "quality").agg(F.count("*").alias("sampled"), F.sum("made").alias("made"), F.first("n_pages").alias("n_pages"))
    return rows.select("book", "width", "quality", "sampled", F.expr("made div sampled").alias("per_page"), F.expr("made * n_pages div sampled").alias("whole_book"))


@query
def image_dedup(spark, sf):
    return health.unique_images(views.line_images(spark, sf), "doc", "obj", ["page", "raw", "made"]).select("doc", "obj", "page", "raw", "made")


@query
def single_image_pages(spark, sf):
    return health.sole_images(views.line_images(spark, sf), ["doc", "page"]).where(F.col("page").isin(1, 3)).select("doc", "page", "obj", "raw")


@query
def pdf_health(spark, sf):
    images = health.unique_images(views.line_images(spark, sf), "doc", "obj", ["page", "raw", "made", "bilevel", "decoded"])
    rows = health.composition(images, "doc").join(health.sampled_ratio(images, "doc", ["page", "obj"], 3), "doc")
    est = health.estimate(F.col("size"), F.col("bilevel_bytes"), F.col("ratio"))
    save = health.saving(F.col("size"), est, F.col("n_bilevel"))
    return rows.select("doc", "n_bilevel", "n_colour", "bilevel_bytes", "colour_bytes", "size", "kind", F.round(est, 4).alias("estimate"), F.round(save, 8).alias("saving"))


@query
def health_report(spark, sf):
    images = views.line_images(spark, sf).withColumn("shelf", F.col("doc") % 40)
    return health.report(health.composition(images, "shelf"), "shelf")


@query
def sampled_ratio(spark, sf):
    rows = health.sampled_ratio(views.line_images(spark, sf), "doc", ["page", "obj", "raw", "made"], 2)
    return rows.select("doc", F.round("ratio", 10).alias("ratio"), "sampled")


@query
def has_text_first30(spark, sf):
    pages = ordinals(views.document_pages(spark, sf), ["book"], "page_no").where("ord <= 30")
    return pages.groupBy("book").agg(F.bool_or(F.col("bytes") > 9000).alias("has_text"), F.count("*").alias("looked_at"))


@query
def format_histogram(spark, sf):
    pages = views.read(spark, sf, "pages").select(F.lit("all").alias("book"), F.col("page_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    sample = selection.stride_sample(pages, "book", "page_id", 12, capped=False)
    return sample.groupBy(T.sniff_format(F.col("content")).alias("format")).agg(F.count("*").alias("n"))


@query
def hue_histogram(spark, sf):
    return colour.hue_histogram(views.vector_pixels(spark, sf), "vec_id")


@query
def top3_hues(spark, sf):
    found = colour.ink_colours(colour.hue_histogram(views.vector_pixels(spark, sf), "vec_id"), "vec_id")
    return found.select("vec_id", "slot", "peak", "n", *(F.round(c, 8).alias(c) for c in "rgb"))


@query
def hue_runs(spark, sf):
    runs = colour.hue_runs(colour.hue_histogram(views.vector_pixels(spark, sf), "vec_id"), "vec_id")
    return runs.select("vec_id", "first", "last", "n", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


@query
def op_islands(spark, sf):
    ops = content.text_islands(views.content_operators(spark, sf), "page", "pos", "op")
    return ops.groupBy("page").agg(F.count_if("inside").alias("inside_ops"), F.count_if(F.col("inside") & (F.col("op") == "Tj")).alias("shown"), F.coalesce(F.bool_or(F.col("inside") & (F.col("op") == "Tj")), F.lit(False)).alias("has_text"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("pos"))), F.lit(0)).alias("pos_sum"))


@query
def affine_fold(spark, sf):
    """Events as graphics operators: signup saves, error restores, click and purchase transform, view draws."""
    kind, v = F.col("event_type"), F.col("event_id") % 7
    op = F.when(kind == "signup", "q").when(kind == "error", "Q").when(kind.isin("click", "purchase"), "cm").otherwise("Do")
    m = F.array(*(x.cast("double") for x in (v % 2 + 1, v % 3, F.lit(0), F.lit(1), v, -v)))
    late = F.when((op == "Do") & (F.col("event_id") % 5 != 0), "re").otherwise(op)
    ops = views.read(spark, sf, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), late.alias("op"), m.alias("m"))
    found = content.placement(ops, "page", "pos", "op", "m")
    return found.select("page", *(F.col("ctm")[i].alias(f"m{i}") for i in range(6)))


@query
def reading_order(spark, sf):
    boxes = views.read(spark, sf, "embeddings").select("vec_id", (F.floor(F.col("vec_id") / 10)).alias("page"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return content.reading_order(boxes, "page", "x", "y", "vec_id").select("page", "vec_id", "band", "ord")


@query
def sidecar_text(spark, sf):
    made = content.sidecar(views.recognised_lines(spark, sf), "doc", "page", "text")
    return made.select("doc", "n_pages", F.md5(F.col("sidecar").cast("binary")).alias("digest"))


@query
def merge_offsets(spark, sf):
    inputs = views.recognised_lines(spark, sf).select("doc", "page", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("pages"))
    return assembly.start_offsets(inputs, ["doc"], "page", "pages").select("doc", "page", "pages", "start")


@query
def bilevel_threshold(spark, sf):
    g = raster.white_border(raster.threshold(raster.level(F.col("gray"), 0.15, 0.88), 0.55), 8, 8, 1, 1)
    rows = views.vector_rasters(spark, sf).withColumn("mask", g)
    return rows.select("vec_id", F.size(F.filter("mask", lambda x: x == 0)).alias("black"), F.array_join("mask", ",").alias("mask"))


@query
def mask_algebra(spark, sf):
    g = F.col("gray")
    turned = F.reverse(g)
    made = {"lighten": raster.lighten(g, turned), "darken": raster.darken(g, turned), "multiply": raster.multiply(g, turned), "minus": raster.minus(g, turned), "negate": raster.negate(g), "posterize": raster.posterize(g, 3)}
    total = lambda a: F.aggregate(F.transform(a, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return views.vector_rasters(spark, sf).select("vec_id", *(total(a).alias(k) for k, a in made.items()))


@query
def box_downsample(spark, sf):
    return views.vector_rasters(spark, sf).select("vec_id", F.array_join(raster.box_half(F.col("gray"), 8, 8), ",").alias("half"), G.scaled_height(F.lit(8), F.col("label") + 8, F.lit(4)).alias("height"))


@query
def morph_open(spark, sf):
    opened = raster.morphology("open", 8, 8, 1, diamond=True)
    return views.vector_rasters(spark, sf).select("vec_id", F.array_join(opened(F.col("gray")), ",").alias("opened"))


def vector_channels(spark, sf):
    """vec_id, r, g, b: the triples of a raster as a picture of 2 rows, 11 wide, the last one going on at the first levels."""
    at = F.sequence(F.lit(0), F.lit(21))
    pick = lambda k: F.transform(at, lambda i: F.get("gray", (i * 3 + k) % 64))
    return views.vector_rasters(spark, sf).select("vec_id", *(pick(k).alias(c) for k, c in enumerate("rgb")))


@query
def ink_separation(spark, sf):
    r, g, b = (F.col(c) for c in "rgb")
    rows = vector_channels(spark, sf).select("vec_id", raster.luma(r, g, b).alias("y"), raster.chroma(r, g, b).alias("c"))
    black, coloured = raster.ink_masks(F.col("y"), F.col("c"), 0.5, 0.15)
    return rows.select("vec_id", F.array_join(black, ",").alias("black"), F.array_join(coloured, ",").alias("coloured"))


@query
def inkless_background(spark, sf):
    rows = views.vector_rasters(spark, sf).withColumn("ink", F.transform("gray", lambda g: F.when(g < 115, 255).otherwise(0)))
    return rows.select("vec_id", F.array_join(raster.background_half(F.col("gray"), F.col("ink"), 8, 8), ",").alias("paper"))


@query
def tone_curve(spark, sf):
    return views.vector_rasters(spark, sf).select("vec_id", F.array_join(raster.sigmoidal(F.col("gray"), 3.5, 0.5), ",").alias("toned"))


@query
def pixel_equality(spark, sf):
    masks = views.vector_rasters(spark, sf).select("vec_id", raster.mask_digest(F.col("gray")).alias("digest"))
    return masks.groupBy("digest").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@query
def a4_fit(spark, sf):
    w, h = F.col("p_size") * 20.0, F.col("p_retailprice")
    box = G.a4_fit(w, h)
    return views.read(spark, sf, "part").select("p_partkey", *(F.round(box[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")), G.is_a4(w, h).alias("already"), F.round(G.dpi_on_a4(w), 6).alias("dpi"))


@query
def text_geometry(spark, sf):
    n = F.length("text")
    box = G.text_box(n.cast("double"), F.lit(0.5), (F.col("page") + 1) / F.lit(40.0), F.lit(G.A4_WIDTH), F.lit(G.A4_HEIGHT))
    lines = views.recognised_lines(spark, sf).where("length(text) > 0")
    return lines.select("doc", "page", F.round(box["size"], 6).alias("size"), F.round(box["stretch"], 6).alias("stretch"))


@query
def language_fallback(spark, sf):
    """Per document the labelled language pass with most confidence, the first at a tie; none gives the default."""
    docs, labels = views.read(spark, sf, "documents"), views.read(spark, sf, "labels")
    tries = F.posexplode(F.array(*map(F.lit, ("de", "en", "fr")))).alias("ord", "try_lang")
    scored = docs.join(labels, "doc_id", "left").select("doc_id", "lang", "quality", tries)
    conf = F.when(F.col("lang") == F.col("try_lang"), 90).otherwise(F.lit(40) + F.coalesce("quality", F.lit(0)))
    best = F.max(F.struct(conf.alias("conf"), (-F.col("ord")).alias("rank"), F.col("try_lang").alias("lang")))
    return scored.groupBy("doc_id").agg(best.alias("b"), F.coalesce(F.avg(F.when(F.col("quality").isNotNull(), conf)), F.lit(0.0)).alias("mean")).select("doc_id", F.col("b.lang").alias("lang"), F.col("b.conf").alias("conf"), F.round("mean", 6).alias("mean"))


@query
def job_latest(spark, sf):
    rows = jobs.latest(jobs.decode(views.progress_lines(spark, sf)))
    return rows.select("job", "lines", "finished", "seq", F.round("progress", 9).alias("progress"), "kind", "stage")


@query
def stream_progress(spark, sf):
    """The latest states again, by a stream over the events."""
    return progress.stream_events(spark, sf).select("job", "lines", "finished", "seq", F.round("progress", 9).alias("progress"), "kind", "stage")


@query
def stream_framing(spark, sf):
    """Lines put together by a stream whose chunks end in the middle of lines."""
    return progress.stream_framed_events(spark, sf).select("job", "line_no", "line")


def event_queue(spark, sf):
    """Jobs by their first line: one of three by number runs, the others wait."""
    firsts = views.progress_lines(spark, sf).groupBy("job").agg(F.min("seq").alias("asked"))
    return firsts.withColumn("state", F.when(F.col("job") % 3 == 0, "running").otherwise("waiting"))


@query
def job_admission(spark, sf):
    """Which waiting jobs may start when twelve more than the running ones, as many as are running now, may run."""
    queue = event_queue(spark, sf).where("state = 'waiting' or job % 6 = 0 and job < 60")
    return jobs.admit(queue, "asked", 22).select("job", "asked", "state")


@query
def queue_counts(spark, sf):
    queue = event_queue(spark, sf).withColumn("shelf", F.col("job") % 7)
    return jobs.queue_counts(queue.withColumn("state", F.when(F.col("job") % 5 == 0, "done").otherwise(F.col("state"))), "shelf")


@query
def line_framing(spark, sf):
    """Progress lines sent in chunks that break anywhere; each job's last line has no end."""
    line = F.col("line")
    cut = F.col("seq") % 4
    chunks = views.progress_lines(spark, sf).select("job", (F.col("seq") * 2).alias("seq"), F.concat(F.lit("\n"), F.left(line, cut.cast("int"))).alias("text")).unionByName(views.progress_lines(spark, sf).select("job", (F.col("seq") * 2 + 1).alias("seq"), F.substr(line, (cut + 1).cast("int")).alias("text")))
    return jobs.framed_lines(chunks, "job", "seq", "text")


@query
def active_dedup(spark, sf):
    lines = views.progress_lines(spark, sf).withColumn("args", F.concat_ws(" ", F.col("job").cast("string"), F.substring("line", 1, 6)))
    active = lines.where("seq % 10 = 0")
    return jobs.new_jobs(lines.select("args"), active, "args")


@query
def progress_milestones(spark, sf):
    pages = ordinals(views.document_pages(spark, sf), ["book"], "page_no", total="n")
    every = F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    return pages.where((F.col("ord") % every == 0) | (F.col("ord") == F.col("n"))).select("book", "page_no", "ord", "n")


@query
def free_name(spark, sf):
    """Per book the lowest number from 2 on that no page uses."""
    used = views.document_pages(spark, sf).select("book", F.floor(F.col("page_no") / 20 + 2).cast("bigint").alias("n")).where("n % 5 <> 4").distinct()
    # The next number after a used one (or 2 itself) that is free: a gap starts where n + 1 is unused.
    starts = used.select("book").distinct().withColumn("n", F.lit(2).cast("bigint")).unionByName(used.select("book", (F.col("n") + 1).alias("n"))).distinct()
    return starts.join(used, ["book", "n"], "left_anti").groupBy("book").agg(F.min("n").alias("free"))


@query
def format_scalars(spark, sf):
    part = views.read(spark, sf, "part")
    key = F.col("p_partkey")
    size = F.rint(F.col("p_retailprice") * 1000).cast("bigint") * F.col("p_size") + key
    name = F.concat(F.lit(" "), F.translate("p_name", " ", "/"), F.lit(":v\\2 "))
    return part.select("p_partkey", T.human_size(size).alias("human"), T.duration(key * 37 % 9000).alias("took"), T.safe_name(name).alias("safe"), T.with_suffix(F.concat(F.col("p_name"), F.lit(".pdf")), "_slim").alias("slim"), T.padded("p", key, ".png").alias("page"), T.percent_literal((F.col("p_size")).cast("string")).alias("pct"), T.summary(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")), F.lit("x")).alias("summary"), F.upper(F.hex(F.encode("p_brand", "UTF-16BE"))).alias("utf16"))


@query
def dir_size(spark, sf):
    return files.folder_size(spark, sf)


@query
def dependency_closure(spark, sf):
    """What every part needs by way of k to k div 2."""
    steps = views.read(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.expr("p_partkey div 2").alias("needs")).where("needs > 0")
    return closure(steps, "part", "needs")


@query
def source_union(spark, sf):
    a = views.read(spark, sf, "documents").select(F.lit(0).alias("arg"), F.format_string("%s/%d.pdf", F.col("source"), F.col("doc_id") % 100).alias("path"))
    b = views.read(spark, sf, "conversations").select(F.lit(1).alias("arg"), F.format_string("src%d/%d.pdf", F.col("conv_id") % 20, F.col("turn")).alias("path"))
    return a.unionByName(b).groupBy("path").agg(F.min("arg").alias("arg")).withColumn("name", T.base_name(F.col("path")))


@query
def json_rows(spark, sf):
    """Props parsed, bad lines dropped, written back with a number as text key."""
    events = views.read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("{bad")).otherwise(F.col("props")).alias("line"))
    parsed = events.withColumn("p", F.from_json("line", "k long")).where("p.k is not null")
    return parsed.select("event_id", F.col("p.k").alias("k"), F.to_json(F.create_map(F.col("event_id").cast("string"), F.col("p.k"))).alias("out"))


@query
def page_sort(spark, sf):
    """Two numbering rules for names with a letter after the digits, and the position by number and name, numbers repeated."""
    number = F.floor(F.col("page_no") / 3)
    names = views.document_pages(spark, sf).select("book", F.concat(F.lit("a"), number.cast("string"), F.element_at(F.array(F.lit("_b"), F.lit(""), F.lit("_c")), (F.col("page_no") % 3 + 1).cast("int")), F.lit(".jpg")).alias("name"))
    numbered = names.withColumn("engine", T.last_number(T.stem(F.col("name")))).withColumn("shell", T.trailing_number(T.stem(F.col("name"))))
    return ordinals(numbered, ["book"], "engine", ties=("name",)).select("book", "name", "engine", "shell", "ord")


@query
def run_counters(spark, sf):
    rows = views.line_images(spark, sf)
    return rows.groupBy("page").agg(F.count_if(~F.col("decoded")).alias("skipped"), F.count_if("decoded").alias("made"), F.sum(F.when(F.col("bilevel"), F.col("raw")).otherwise(0)).alias("selected_bytes"), F.count_distinct(F.when(F.col("bilevel"), F.col("obj"))).alias("objects"), F.array_join(F.array_sort(F.collect_set(F.col("raw") % 7000)), ",").alias("sizes"))


@query
def log_tail(spark, sf):
    return jobs.log_tail(views.progress_lines(spark, sf))


@query
def log_tail_cut(spark, sf):
    """Logs that are cut again and again: at 400 characters to the last 300, over slices of 2048 lines."""
    return jobs.log_tail(views.progress_lines(spark, sf), 400, 300, width=2048, fan=2)


@query
def layer_colours(spark, sf):
    """Mean levels per label as nested rows: a map from label to its channels, then read back."""
    pixels = views.vector_pixels(spark, sf).join(views.vector_rasters(spark, sf).select("vec_id", "label"), "vec_id")
    sums = pixels.groupBy("label").agg(*(F.sum(c).alias(c) for c in "rgb"), F.count("*").alias("n"))
    nested = sums.select("label", F.create_map(F.col("label").cast("string"), F.array(F.struct("r", "g", "b", "n"))).alias("colours"))
    back = nested.select(F.explode("colours").alias("key", "rgbs")).select(F.col("key").cast("int").alias("label"), F.explode("rgbs").alias("c"))
    return back.select("label", "c.r", "c.g", "c.b", "c.n")


@query
def resume_stage(spark, sf):
    """Pages whose result for today's parameters is absent or empty."""
    key = lambda page: assembly.stage_key(page, F.lit(1800), F.lit("55%"))
    pages = views.read(spark, sf, "documents").select("doc_id", key(F.col("doc_id")).alias("key"))
    stage = views.read(spark, sf, "labels").select(key(F.col("doc_id")).alias("key"), (F.col("quality") * 10).alias("length"))
    return assembly.to_do(pages, stage, "key").select("doc_id")


@query
def content_text(spark, sf):
    """Content streams parsed; per page its operators, the text carried over as a stream, and the matrix at its first image."""
    pages = views.page_streams(spark, sf)
    ops = streams.stream_operators(pages, "page", "stream")
    text = content.carried_text(ops, "page", "pos", "op", streams.written(F.col("op"), F.col("args")))
    ctm = content.placement(streams.matrices(ops), "page", "pos", "op", "m")
    counts = ops.groupBy("page").agg(F.count("*").alias("n_ops"))
    found = pages.select("page").join(counts, "page", "left").join(text, "page", "left").join(ctm, "page", "left")
    return found.select("page", "n_ops", "text", *(F.col("ctm")[i].alias(f"m{i}") for i in range(6)))


@query
def stage_complete(spark, sf):
    """Per source the documents without a label: how many of how many, and the first."""
    docs = views.read(spark, sf, "documents").select("source", "doc_id")
    return stages.missing_report(docs, docs.join(views.read(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), "source", "doc_id")


@query
def replaced_streams(spark, sf):
    """Documents' streams against results that exist for some of them: the smaller one stays."""
    images = views.document_pages(spark, sf).select("book", "page_no", F.col("bytes").alias("raw"))
    made = views.read(spark, sf, "labels").groupBy("doc_id").agg(F.max((F.col("quality") * 4000 + F.col("doc_id") % 3000).cast("bigint")).alias("made")).withColumnRenamed("doc_id", "page_no")
    return assembly.replaced(images, made, ["page_no"], "raw", "made").groupBy("book").agg(F.count("*").alias("images"), F.count_if("is_new").alias("replaced"), F.sum("raw").alias("before"), F.sum("kept").alias("after"))


@query
def remade_pages(spark, sf):
    """All pages, remade ones in place of the originals."""
    pages = views.document_pages(spark, sf).select("page_no", F.concat(F.lit("page "), F.col("page_no").cast("string")).alias("body"))
    made = views.read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("page_no"), F.lit("remade").alias("body")).distinct()
    return assembly.remade(pages, made, "page_no", "body")


@query
def page_colours(spark, sf):
    """Pages joined with the ink colours found on them."""
    found = colour.ink_colours(colour.hue_histogram(views.vector_pixels(spark, sf), "vec_id"), "vec_id")
    pages = views.read(spark, sf, "embeddings").select("vec_id", "label")
    return pages.join(found, "vec_id").groupBy("vec_id", "label").agg(F.count("*").alias("colours"), F.max("n").alias("largest"))


@query
def layer_order(spark, sf):
    """Layers in the order they are drawn: the background first, then by name; and that order after a user's swap."""
    names = F.explode(F.array(F.lit("/M1"), F.lit("/Bg"), F.lit("/M0"), F.lit("/Im"))).alias("name")
    layers = assembly.draw_order(views.read(spark, sf, "embeddings").select("vec_id", names), "vec_id", "name", "/Bg")
    return assembly.swapped(layers.withColumn("moved", F.col("ord")), "vec_id", "moved", F.col("vec_id") % 5)


@query
def first_clashes(spark, sf):
    """The first five outputs that would be written over."""
    there = views.read(spark, sf, "labels").select(F.format_string("image%05d.jpg", F.col("doc_id")).alias("fname"))
    return stages.first_clashes(views.document_pages(spark, sf), there, "fname")


@query
def masked_hues(spark, sf):
    """Hue histograms of the pixels that a mask lets through, and the state that a later run reads back."""
    pixels = views.vector_pixels(spark, sf).withColumn("mask", F.col("r") + F.col("i") * 3)
    found = colour.ink_colours(colour.hue_histogram(pixels, "vec_id", "mask"), "vec_id")
    back = colour.colours_from_json(colour.colours_as_json(found, "vec_id"), "vec_id")
    return found.select("vec_id", "slot", "peak", "n").join(back, ["vec_id", "slot"]).select("vec_id", "slot", "peak", "n", *(F.round(c, 8).alias(c) for c in "rgb"))


@query
def existing_outputs(spark, sf):
    """Outputs of chosen jobs that exist."""
    asked = views.document_pages(spark, sf).select("book", T.with_suffix(F.concat(F.lit("p"), F.col("page_no").cast("string"), F.lit(".pdf")), "_slim").alias("name"))
    there = views.read(spark, sf, "labels").select(F.format_string("p%d_slim.pdf", F.col("doc_id")).alias("name")).distinct()
    return asked.join(there, "name", "left_semi").select("book", "name")


@query
def bilevel_selection(spark, sf):
    """Only documents for which recompression saves something, with their saving."""
    return pdf_health(spark, sf).where("saving is not null").select("doc", "saving")


@query
def binarize_page(spark, sf):
    """Rasters levelled, sharpened and thresholded, margins whitened."""
    run = raster.kernel(lambda a: raster.binarized(a, 1800, 0.55, ("level", "unsharp")), 8, 8)
    return views.vector_rasters(spark, sf).select("vec_id", F.array_join(run("gray"), ",").alias("mask"))


@query
def shrink_page(spark, sf):
    """Rasters at half their width."""
    run = raster.kernel(lambda a: raster.shrunk(a, 4), 8, 8)
    return views.vector_rasters(spark, sf).select("vec_id", F.array_join(run("gray"), ",").alias("half"))


@query
def smooth_page(spark, sf):
    run = raster.kernel(lambda a: raster.smoothed(a, 8, 0.55, ("level", "unsharp")), 8, 8)
    return views.vector_rasters(spark, sf).select("vec_id", F.array_join(run("gray"), ",").alias("mask"))


@query
def fine_structure(spark, sf):
    """Coloured ink of pictures of 2 rows, less its large areas."""
    run = raster.colour_kernel(raster.fine_structure, 11, 2)
    return vector_channels(spark, sf).select("vec_id", F.array_join(run("r", "g", "b"), ",").alias("ink"))


@query
def binarize_scan(spark, sf):
    """Whole scans, tile by tile: shrunk from 500 to 400, levelled, sharpened, thresholded, margins whitened; sums a row."""
    return tiles.row_sums(tiles.tiled(views.text_scans(spark, sf), "book", tiles.binarizing(400), tile=256), "book")


@query
def smooth_scan(spark, sf):
    """A sheet of any height thresholded at four times its size, outlines smoothed, brought to 100 and three levels."""
    return tiles.row_sums(tiles.tiled(views.vector_sheet(spark, sf), "sheet", tiles.smoothing(100), tile=64), "sheet")


@query
def fine_scan(spark, sf):
    """Coloured ink of a sheet at twice its size, less its large areas."""
    return tiles.row_sums(tiles.tiled(views.vector_sheet(spark, sf, 3), "sheet", [tiles.by_factor(2), *tiles.fine_structure()], tile=64, bands=3), "sheet")


@query
def page_background(spark, sf):
    """A sheet's colours without black ink, brought from 128 to 100 and toned."""
    return tiles.row_sums(tiles.tiled(views.vector_sheet(spark, sf, 3), "sheet", tiles.background(100), tile=64, bands=3), "sheet", bands=3)


@query
def cluster_masks(spark, sf):
    """Masks of the three ink colours of a sheet: how much each slot draws, row by row."""
    found = colour.ink_colours(colour.hue_histogram(views.vector_pixels(spark, sf).withColumn("sheet", F.lit(0)), "sheet"), "sheet")
    near = F.transform(F.sequence(F.lit(-colour.SPAN), F.lit(colour.SPAN)), lambda d: F.pmod(F.col("peak") + d, F.lit(colour.BINS)))
    masks = tiles.slot_masks(views.vector_sheet(spark, sf, 3), "sheet", found.select("sheet", "slot", near.alias("bins")), tile=64)
    return tiles.row_sums(masks.withColumn("sheet", F.col("slot")), "sheet").withColumnRenamed("sheet", "slot")


@query
def glyph_dictionary(spark, sf):
    """Sheets of labels cut to black and white, their glyphs found by tiles, and the different glyphs of every three sheets."""
    sheets = tiles.tiled(views.label_sheets(spark, sf), "label", [tiles.cut_at(38)], tile=64)
    pieces = stored(glyphs.with_glyphs(stored(glyphs.glyph_pieces(sheets, "label"), "pieces"), "label"), "glyphs")
    table = glyphs.glyph_table(pieces, "label").withColumn("chunk", F.floor(F.col("label") / 3).cast("bigint"))
    return glyphs.dictionary(table, "label", "chunk").drop("code1", "code2")


@query
def page_scalars(spark, sf):
    """Sizes, margins, specs, titles and text lines of parts."""
    part = views.spread(spark, views.read(spark, sf, "part"), "p_partkey")
    key, size = F.col("p_partkey"), F.col("p_size")
    spec = F.concat_ws(",", key.cast("string"), F.format_string("%d-%d", size, size + 3), F.when(key % 3 == 0, "x").when(key % 3 == 1, " "))
    fit, margin = G.raster_size(size * 20.0, F.col("p_retailprice"), F.lit(100)), G.border((key % 4000).cast("int"), size * 100, 2)
    line = T.text_line(F.col("p_brand"), F.col("p_retailprice") / 7, size + 0.25, key / F.lit(8.0), size / F.lit(4.0))
    numbers = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return part.select("p_partkey", fit["h"].alias("height"), margin["x"].alias("left"), margin["y"].alias("top"), F.round(G.zoom_back((size * 60).cast("int"), F.lit(1200)), 6).alias("zoom"), numbers(T.parse_page_spec(spec)).alias("strict"), numbers(T.parse_ranges(spec)).alias("loose"), T.ranges_error(spec).alias("wrong"), T.title_or_stem(F.when(key % 2 == 0, F.col("p_name")).when(key % 4 == 1, " "), F.concat(F.lit("/a/b."), key.cast("string"), F.lit(".pdf"))).alias("title"), T.failure_text(F.encode(F.concat(F.lit("  "), F.repeat("p_name", F.lit(40))), "UTF-8")).alias("failure"), F.regexp_extract(line, r"^(\S+ \S+ Tf) ", 1).alias("font"))
