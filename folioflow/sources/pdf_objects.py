"""Objects of PDF files: where they are, what they say, what their streams hold.

The last cross-reference section is followed with all that it updates, be it a table, a stream or both; objects packed into
object streams are unpacked; where the references lead nowhere, the objects that can be found in the file count, the last of
a number first. Each object is a row with its dictionary as a flat map, nested keys joined by '/', values as written; what
the objects mean is asked of these rows in ``sources.pdf``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Comments, names, strings, hexadecimal strings, brackets, and all other words.
TOKEN = re.compile(rb"%[^\r\n]*|/[^\s()<>\[\]{}/%]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|[^\s()<>\[\]{}/%]+", re.S)
HEAD = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
REFERENCE = re.compile(r"(\d+) (\d+) R")
OBJECTS = "path string, num int, gen int, value string, entries map<string,string>, raw_bytes long, stream binary, error string"


def read_value(raw: bytes, at: int) -> tuple[str, dict[str, str], int, bytes]:
    """The value at a place as written, its flat entries where it is a dictionary, where it ends, and the word after it."""
    words: list[str] = []
    entries: dict[str, str] = {}
    path: list[str | None] = []  # of open brackets: a key's name, or None for an array
    had: list[int] = []  # entries when the dictionaries below a key were opened
    key, waiting = None, []  # the key whose value is being read, and its words so far

    def settle() -> None:
        nonlocal key, waiting
        if key is not None:
            entries["/".join([*(p for p in path if p), key])] = " ".join(waiting)
        key, waiting = None, []

    depth = 0
    for m in TOKEN.finditer(raw, at):
        word = m[0].decode("latin-1")
        if word.startswith("%"):
            continue
        if not depth and (word in ("endobj", "stream", "obj") or (words and word == "<<")):
            return " ".join(words), entries, m.end(), m[0]
        words.append(word)
        in_array = None in path
        if word == "<<":
            if depth and not in_array:
                path.append(key)
                had.append(len(entries))
                key, waiting = None, []
            elif in_array:
                waiting.append(word)
            depth += 1
        elif word == ">>":
            depth -= 1
            if in_array:
                waiting.append(word)
            else:
                settle()
                if path:
                    if had.pop() == len(entries):  # an empty dictionary is an entry itself
                        entries["/".join(p for p in path if p)] = "<< >>"
                    path.pop()
        elif word == "[":
            depth += 1
            path.append(None)
            waiting.append(word)
        elif word == "]":
            depth -= 1
            waiting.append(word)
            if path and path[-1] is None:
                path.pop()
        elif word.startswith("/") and depth and not in_array and (key is None or waiting):
            settle()
            key = word[1:]
        else:
            waiting.append(word)
        if depth < 0:
            break
    return " ".join(words), entries, len(raw), b""


def unfiltered(data: bytes, entries: dict[str, str]) -> bytes | None:
    """A stream's bytes: as they are, or inflated with predictors undone; null for other filters and bad data."""
    names = re.findall(r"/(\w+)", entries.get("Filter", ""))
    if not names:
        return data
    if names not in (["FlateDecode"], ["Fl"]):
        return None
    try:
        inflater = zlib.decompressobj()
        data = inflater.decompress(data) + inflater.flush()
    except zlib.error:
        return None
    number = lambda name, default: int(m[0]) if (m := re.search(r"\d+", entries.get(f"DecodeParms/{name}", "") or (re.search(rf"/{name} (\d+)", entries.get("DecodeParms", "")) or ["", ""])[1])) else default
    kind, columns, colours, bits = number("Predictor", 1), number("Columns", 1), number("Colors", 1), number("BitsPerComponent", 8)
    width, pixel = -(-columns * colours * bits // 8), max(1, colours * bits // 8)
    if kind < 2 or not data:
        return data
    if kind == 2:
        if bits != 8:
            return None
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colours)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    lines = np.frombuffer(data + b"\0" * (-len(data) % (width + 1)), np.uint8).reshape(-1, width + 1)
    above, out = bytearray(width), []
    for line in lines:
        above = undone(int(line[0]), line[1:], above, pixel)
        out.append(bytes(above))
    return b"".join(out)


def undone(kind: int, line: np.ndarray, above: bytearray, pixel: int) -> bytearray:
    """One line whose bytes were stored as differences from the bytes ``pixel`` before, above or both."""
    if kind == 0:
        return bytearray(line.tobytes())
    if kind == 2:
        return bytearray((line + np.frombuffer(bytes(above), np.uint8)).astype(np.uint8).tobytes())
    made = bytearray(line.tobytes())
    for i in range(len(made)):
        left, up, corner = (made[i - pixel], above[i], above[i - pixel]) if i >= pixel else (0, above[i], 0)
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up) // 2
        else:
            far = (abs(up - corner), abs(left - corner), abs(left + up - 2 * corner))
            guess = (left, up, corner)[far.index(min(far))]
        made[i] = (made[i] + guess) & 255
    return made


class File:
    """One file's objects by number."""

    def __init__(self, raw: bytes):
        self.raw, self.trailer, self.places = raw, {}, {}
        starts = re.findall(rb"startxref\s+(\d+)", raw)
        try:
            self.follow(int(starts[-1]) if starts else -1)
        except (ValueError, IndexError, KeyError, zlib.error):
            self.places = {}
        if not self.places or not self.rooted():
            self.search()

    def rooted(self) -> bool:
        root = REFERENCE.match(self.trailer.get("Root", ""))
        return bool(root) and self.at(int(root[1])) is not None

    def follow(self, at: int) -> None:
        """Cross-reference sections from the newest to the oldest; what a newer one says of a number stands."""
        waiting, seen = [at], set()
        while waiting:
            at = waiting.pop(0)
            if at in seen or not 0 <= at < len(self.raw):
                continue
            seen.add(at)
            table = re.compile(rb"\s*xref\b").match(self.raw, at)
            if table:
                entries = self.table(table.end())
            else:
                _, entries, data = self.read(at)
                self.rows(entries, unfiltered(data, entries) or b"")
            self.trailer = entries | self.trailer
            waiting += [int(entries[k]) for k in ("XRefStm", "Prev") if entries.get(k, "").isdigit()]

    def table(self, at: int) -> dict[str, str]:
        part = re.compile(rb"\s*(\d+)\s+(\d+)\s*[\r\n]+")
        while m := part.match(self.raw, at):
            first, n, at = int(m[1]), int(m[2]), m.end()
            for k, line in enumerate(re.compile(rb"(\d{10}) (\d{5}) ([nf])\s{1,2}").finditer(self.raw, at, at + 20 * n)):
                self.places.setdefault(first + k, (int(line[1]), None) if line[3] == b"n" else None)
            at += 20 * n
        m = re.compile(rb"\s*trailer\s*").match(self.raw, at)
        return read_value(self.raw, m.end())[1] if m else {}

    def rows(self, entries: dict[str, str], data: bytes) -> None:
        w = [int(x) for x in re.findall(r"\d+", entries["W"])]
        bounds = [int(x) for x in re.findall(r"\d+", entries.get("Index", f"0 {entries['Size']}"))]
        at = 0
        for first, n in zip(bounds[::2], bounds[1::2]):
            for num in range(first, first + n):
                kind, a, b = (int.from_bytes(data[at + sum(w[:k]) : at + sum(w[: k + 1])], "big") for k in range(3))
                at += sum(w)
                if at > len(data):
                    return
                kind = kind if w[0] else 1
                self.places.setdefault(num, (a, None) if kind == 1 else (a, b) if kind == 2 else None)

    def search(self) -> None:
        """All objects that stand in the file, the last of each number, and all trailers, the last first."""
        self.places = {int(m[1]): (m.start(1), None) for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", self.raw)}
        packed = {}
        for num in list(self.places):
            found = self.at(num)
            if found and found[2].get("Type") == "/ObjStm":
                packed |= {inner: (num, k) for k, inner in enumerate(self.inner(num)[0])}
            if found and found[2].get("Type") == "/XRef":
                self.trailer = self.trailer | found[2]
        self.places = packed | self.places
        for m in re.finditer(rb"\btrailer\b", self.raw):
            self.trailer = self.trailer | read_value(self.raw, m.end())[1]
        if not self.trailer.get("Root"):
            roots = [n for n in self.places if (found := self.at(n)) and found[2].get("Type") == "/Catalog"]
            self.trailer = self.trailer | ({"Root": f"{roots[-1]} 0 R"} if roots else {})

    def read(self, at: int) -> tuple[str, dict[str, str], bytes]:
        """Value, entries and stored stream of the object at a place."""
        head = HEAD.match(self.raw, at)
        if not head:
            raise ValueError("no object")
        value, entries, end, word = read_value(self.raw, head.end())
        if word != b"stream":
            return value, entries, b""
        end += 2 if self.raw[end : end + 2] == b"\r\n" else 1
        length = entries.get("Length", "")
        if m := REFERENCE.match(length):
            place = self.places.get(int(m[1]))
            found = re.compile(rb"\s*\d+\s+\d+\s+obj\s*(\d+)").match(self.raw, place[0]) if place and place[1] is None else None
            length = found[1].decode() if found else ""
        if length.isdigit() and re.compile(rb"\s{0,2}endstream").match(self.raw, end + int(length)):
            return value, entries, self.raw[end : end + int(length)]
        stop = self.raw.find(b"endstream", end)
        return value, entries, re.sub(rb"\r?\n$", b"", self.raw[end : stop if stop >= 0 else len(self.raw)])

    def inner(self, num: int) -> tuple[list[int], list[int], bytes]:
        """Numbers and places of the objects in an object stream, and its bytes; read once."""
        if not hasattr(self, "unpacked"):
            self.unpacked = {}
        if num not in self.unpacked:
            place = self.places.get(num)
            _, entries, data = self.read(place[0]) if place and place[1] is None else ("", {}, b"")
            data, first = unfiltered(data, entries) or b"", int(entries.get("First", "0"))
            heads = [int(x) for x in re.findall(rb"\d+", data[:first])]
            self.unpacked[num] = heads[::2], [first + x for x in heads[1::2]], data
        return self.unpacked[num]

    def at(self, num: int) -> tuple[int, str, dict[str, str], bytes] | None:
        """Generation, value, entries and stored stream of an object; null where there is none."""
        place = self.places.get(num)
        if place is None:
            return None
        try:
            if place[1] is None:
                head = HEAD.match(self.raw, place[0])
                return (int(head[2]), *self.read(place[0])) if head and int(head[1]) == num else None
            numbers, starts, data = self.inner(place[0])
            k = place[1] if place[1] < len(numbers) and numbers[place[1]] == num else numbers.index(num)
            end = starts[k + 1] if k + 1 < len(starts) else len(data)
            return (0, *read_value(data[starts[k] : end], 0)[:2], b"")
        except (ValueError, IndexError, TypeError):
            return None


def pdf_objects(files: DataFrame) -> DataFrame:
    """A row per object of files (path, content): path, num, gen, value, entries, raw_bytes, stream and error.

    ``entries`` holds a dictionary's keys, nested ones joined by '/'; ``raw_bytes`` are the bytes of a stored stream, null
    without one; ``stream`` is what it holds, null for pictures and for filters other than Flate. The trailer is number 0. A file
    that is no PDF, is encrypted or has no objects is one row with an error; a file is one row's work.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = {k: [] for k in ("num", "gen", "value", "entries", "raw_bytes", "stream", "error")}

                def add(*values: object) -> None:
                    for k, v in zip(rows, values):  # noqa: B023
                        rows[k].append(v)  # noqa: B023

                raw = raw.as_py() or b""
                if raw[:1024].find(b"%PDF") < 0:
                    add(None, None, None, None, None, None, "not a PDF")
                else:
                    file = File(raw)
                    if "Encrypt" in file.trailer:
                        add(None, None, None, None, None, None, "encrypted")
                    else:
                        add(0, 0, None, list(file.trailer.items()), None, None, None)
                        for num in sorted(n for n in file.places if n):
                            if (found := file.at(num)) is None:
                                continue
                            gen, value, entries, data = found
                            picture = entries.get("Subtype") == "/Image"
                            stored = len(data) if data or "Length" in entries else None
                            add(num, gen, value, list(entries.items()), stored, unfiltered(data, entries) if stored is not None and not picture else None, None)
                        if len(rows["num"]) == 1:
                            rows["error"][0] = "no objects"
                kinds = {"num": pa.int32(), "gen": pa.int32(), "value": pa.string(), "entries": pa.map_(pa.string(), pa.string()), "raw_bytes": pa.int64(), "stream": pa.binary(), "error": pa.string()}
                n = len(rows["num"])
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * n, pa.string())} | {k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return files.select("path", "content").mapInArrow(read, OBJECTS)
