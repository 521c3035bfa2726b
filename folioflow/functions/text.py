"""String functions over names, ranges, sizes and durations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions that count as page images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def last_number(stem_: Column) -> Column:
    """The last run of digits as a number; null if there is none or it exceeds 64 bits."""
    return F.regexp_extract(stem_, r"(\d+)\D*$", 1).try_cast("bigint")


def trailing_number(stem_: Column) -> Column:
    """The digits that end the stem as a number, else null."""
    return F.regexp_extract(stem_, r"(\d+)$", 1).try_cast("bigint")


def is_page_image(name: Column) -> Column:
    """A page image by extension, case aside; names that begin with a dot are none."""
    return ~name.startswith(".") & F.lower(name).rlike(rf"\.({'|'.join(IMAGE_EXTENSIONS)})$")


def once(column: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is worked out once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(column), f), F.lit(0))


def parse_ranges(spec: Column, most: int = 1_000_000) -> Column:
    """'3,7,10-12' as the sorted distinct numbers; blanks are skipped, a leading '-' is a sign, 10-5 is empty.

    Null for a spec that ``ranges_error`` refuses.
    """
    numbers = lambda p: F.when(p["first"] <= p["last"], F.sequence(p["first"], p["last"])).otherwise(F.array().cast("array<bigint>"))
    return once(range_parts(spec), lambda parts: F.when(parts_error(parts, most).isNull(), F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))))


def range_pieces(spec: Column) -> Column:
    return F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")


def range_start(piece: Column) -> Column:
    return F.regexp_extract(piece, r"^(-?\d+)", 1).try_cast("bigint")


def range_end(piece: Column) -> Column:
    return F.coalesce(F.regexp_extract(piece, r"^-?\d+\s*-\s*(-?\d+)$", 1).try_cast("bigint"), range_start(piece))


def range_parts(spec: Column, strict: bool = False) -> Column:
    """A spec's pieces with their first and last number, and whether their shape is a range's."""
    pieces = F.split(spec, ",") if strict else range_pieces(spec)
    shape = r"^\s*\d+(\s*-\s*\d+)?\s*$" if strict else r"^-?\d+(\s*-\s*-?\d+)?$"
    return F.transform(pieces, lambda p: F.struct(p.alias("piece"), p.rlike(shape).alias("shaped"), range_start(F.trim(p)).alias("first"), range_end(F.trim(p)).alias("last")))


def parts_error(parts: Column, most: int) -> Column:
    wrong = F.filter(parts, lambda p: ~p["shaped"] | p["first"].isNull() | p["last"].isNull())
    zero = F.lit(0).cast("decimal(38,0)")
    count = F.aggregate(parts, zero, lambda n, p: n + F.greatest(zero, p["last"].cast("decimal(38,0)") - p["first"] + 1).cast("decimal(38,0)"))
    return once(F.get(wrong, F.lit(0))["piece"], lambda p: F.when(p.isNotNull(), F.concat(F.lit("no range: "), p)).when(count > most, F.lit("too many numbers")))


def ranges_error(spec: Column, most: int = 1_000_000, strict: bool = False) -> Column:
    """What is wrong with a spec, null if nothing: pieces that are no range, and more than ``most`` numbers.

    The strict form refuses blank pieces and signs as well.
    """
    return once(range_parts(spec, strict), lambda parts: parts_error(parts, most))


def parse_page_spec(spec: Column, most: int = 1_000_000) -> Column:
    """The strict form: numbers and ranges alone, else null."""
    return F.when(ranges_error(spec, most, strict=True).isNull(), parse_ranges(spec, most))


def padded(prefix: str, number: Column, suffix: str = "") -> Column:
    """The number in five digits at least, never cut."""
    return F.format_string(f"{prefix}%05d{suffix}", number)


def human_size(bytes_: Column) -> Column:
    """From one MiB on in MB with one decimal, else in whole KB; halves to even, as printf does where Java rounds them up."""
    mib, kib = bytes_ / F.lit(1048576.0), bytes_ / F.lit(1024.0)
    tenths = F.floor(mib) * 10 + F.rint((mib - F.floor(mib)) * 10).cast("bigint")
    return F.when(bytes_ >= 1048576, F.format_string("%d.%d MB", F.floor(tenths / 10), tenths % 10)).otherwise(F.format_string("%.0f KB", F.rint(kib)))


def duration(seconds: Column) -> Column:
    """Seconds as '12s', '3m 4s' (no zero seconds) or '1h 5m'."""
    m, s = F.expr("bigint(0)") + F.floor(seconds / 60), seconds % 60
    short = F.format_string("%ds", seconds)
    minutes = F.when(s == 0, F.format_string("%dm", m)).otherwise(F.format_string("%dm %ds", m, s))
    hours = F.format_string("%dh %dm", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60))
    return F.when(seconds < 60, short).when(seconds < 3600, minutes).otherwise(hours)


def safe_name(name: Column) -> Column:
    """Without control characters, slashes, colons and backslashes, trimmed, at most 120 characters."""
    return F.left(F.trim(F.regexp_replace(name, r"[\x00-\x1F\x7F/:\\]", "")), F.lit(120))


def with_suffix(name: Column, suffix: str) -> Column:
    """'book.pdf' to 'book_slim.pdf'."""
    return F.concat(stem(name), F.lit(suffix), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))


def percent_literal(text: Column) -> Column:
    """'55%' or '55' as '55%'."""
    return F.concat(F.rtrim(text, F.lit("%")), F.lit("%"))


def sniff_format(content: Column) -> Column:
    """The true format from the first bytes; unknown ones as their first four bytes in hex."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("FFD8"), "jpeg").when(head == "89504E47", "png").when(head.isin("49492A00", "4D4D002A"), "tiff").when(head == "25504446", "pdf").otherwise(F.lower(head))


def failure_text(raw: Column, most: int = 300) -> Column:
    """Bytes as UTF-8, wrong ones replaced, trimmed and cut to ``most`` characters."""
    return F.left(F.trim(F.make_valid_utf8(raw.cast("string"))), F.lit(most))


def title_or_stem(title: Column, path: Column) -> Column:
    """The title, or the output's name without extension where it is null or blank."""
    return F.coalesce(F.when(F.trim(title) != "", title), stem(base_name(path)))


def summary(*parts: Column) -> Column:
    """Parts of a job's summary that are there, with dots between."""
    return F.concat_ws(" · ", *parts)


def text_line(text: Column, size: Column, stretch: Column, x: Column, y: Column, font: str = "/Recognised") -> Column:
    """The operators that place one invisible line: font and size, scaling, matrix, and UTF-16BE code units."""
    return F.format_string(f"{font} %.2f Tf %.1f Tz 1 0 0 1 %.2f %.2f Tm <%s> Tj", size, stretch, x, y, F.hex(F.encode(text, "UTF-16BE")))


def text_layer(lines: Column) -> Column:
    """A page's invisible text: its lines (null: none) in one text object that is neither filled nor stroked."""
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    return F.array_join(F.concat(words("q", "BT", "3 Tr"), F.coalesce(F.filter(lines, lambda x: x.isNotNull()), F.array().cast("array<string>")), words("ET", "Q")), "\n")


def unicode_map(block: int = 100) -> str:
    """A character map in which every code stands for itself: 256 ranges of one high byte, at most ``block`` in a block."""
    ranges = [f"<{high:02X}00> <{high:02X}FF> <{high:02X}00>" for high in range(256)]
    blocks = [ranges[i : i + block] for i in range(0, 256, block)]
    #: What a map of this kind must say before and after its ranges.
    before = ["/CIDInit /ProcSet findresource begin", "12 dict begin", "begincmap", "/CMapName /Own-Codes def", "/CMapType 2 def", "1 begincodespacerange", "<0000> <FFFF>", "endcodespacerange"]
    after = ["endcmap", "CMapName currentdict /CMap defineresource pop", "end", "end"]
    return "\n".join([*before, *(line for b in blocks for line in (f"{len(b)} beginbfrange", *b, "endbfrange")), *after, ""])
