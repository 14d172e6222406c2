"""The header grammar of documents: parsing, serialising and typed access.

A header is a small subset of YAML: scalars (text, 64-bit integers, booleans), lists of
text and flat objects.  One grammar in Python serves whole columns through Arrow
batches; access to parsed headers is by DataFrame expressions.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = "---"
LINE_LIMIT = 200
INT_MAX = 2**63 - 1

#: Spark type of a header: its entries in order.
SCALAR_TYPE = "kind:string,s:string,i:bigint,b:boolean"
HEADER_TYPE = f"array<struct<key:string,{SCALAR_TYPE},list:array<string>,obj:array<struct<key:string,{SCALAR_TYPE}>>>>"
_SCALAR_FIELDS = [("kind", pa.string()), ("s", pa.string()), ("i", pa.int64()), ("b", pa.bool_())]
HEADER_ARROW = pa.list_(pa.struct([("key", pa.string()), *_SCALAR_FIELDS, ("list", pa.list_(pa.string())), ("obj", pa.list_(pa.struct([("key", pa.string()), *_SCALAR_FIELDS])))]))

_ENTRY = re.compile(r"([^:]*):(.*)", re.S)
_INTEGER = re.compile(r"-?[0-9]+")
_ESCAPE = re.compile(r"\\(?:([abfnrtv\\\"])|x([0-9A-Fa-f]{2})|([0-7]{3})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))")
#: What escapes of one letter stand for.
_LETTER_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}
#: Characters that may not start an unquoted value.
_INDICATORS = "[{}]|>&*!%@`"
#: Fixed value: the one error text that users of such headers match on.
NO_COMMENTS = "comments are not supported; quote '#' if literal"


_CLOSING = re.compile(rf"\n{FENCE}\r?(?=\n|\Z)")


class HeaderError(ValueError):
    """A header that breaks the grammar; the line is counted from the start of the text."""

    def __init__(self, line: int, what: str):
        super().__init__(f"line {line}: {what}" if line else what)
        self.line, self.what = line, what


@dataclasses.dataclass(frozen=True)
class Options:
    line_limit: int = LINE_LIMIT  # 0: none
    require_fence: bool = True
    trim_body: bool = True
    #: A blank line after an object entry is an error, as in the files' own tool.
    strict_objects: bool = True


def _unquote(text: str) -> str:
    """A quoted string's value; ValueError if it isn't well formed."""
    quote = text[0]
    if len(text) < 2 or text[-1] != quote:
        raise ValueError("a quoted text needs its second quote")
    inner = text[1:-1]
    if quote == "'":
        return inner
    rest = _ESCAPE.sub("", inner)
    if "\\" in rest or '"' in rest or "\n" in rest:
        raise ValueError("a quoted text holds an unknown escape, a bare quote or a line end")
    raw = bytearray()
    at = 0
    for m in _ESCAPE.finditer(inner):
        raw += inner[at : m.start()].encode()
        at = m.end()
        letter, two, octal, four, eight = m.groups()
        if letter:
            raw += _LETTER_ESCAPES[letter].encode()
        elif two or octal:
            value = int(two, 16) if two else int(octal, 8)
            if value > 255:
                raise ValueError("a quoted text holds an unknown escape, a bare quote or a line end")
            raw.append(value)
        else:
            point = int(four or eight, 16)
            if point > 0x10FFFF or 0xD800 <= point < 0xE000:
                raise ValueError("a quoted text holds an unknown escape, a bare quote or a line end")
            raw += chr(point).encode()
    raw += inner[at:].encode()
    return raw.decode("utf-8", "replace")


def _plain(text: str) -> str:
    """Text that may be quoted, as list items are."""
    if text[:1] in ("'", '"'):
        return _unquote(text)
    if "#" in text:
        raise ValueError(NO_COMMENTS)
    return text


def scalar(text: str) -> dict:
    """The typed value of a scalar as written."""
    if not text:
        raise ValueError("a value is empty")
    value = _plain(text)
    if text[0] not in "'\"":
        if text[0] in _INDICATORS or text.startswith("- "):
            raise ValueError("a value starts with a character kept for other forms")
        if text in ("true", "false"):
            return {"kind": "bool", "s": None, "i": None, "b": text == "true"}
        if _INTEGER.fullmatch(text) and abs(int(text)) <= INT_MAX:
            return {"kind": "int", "s": None, "i": int(text), "b": None}
    return {"kind": "string", "s": value, "i": None, "b": None}


def _inline_list(text: str) -> list[str]:
    if not text.endswith("]"):
        raise ValueError("a list needs its closing bracket")
    inner = text[1:-1]
    if not inner:
        return []
    first, *others = inner.split(",")
    if any(not x.startswith(" ") for x in others):
        raise ValueError("list items are parted by a comma and one space")
    return [_item(x) for x in (first, *(x[1:] for x in others))]


def _item(text: str) -> str:
    if not text:
        raise ValueError("a list has an empty item")
    if text != text.strip(" \t"):
        raise ValueError("a list item has blanks around it")
    if not (value := _plain(text)):
        raise ValueError("a list has an empty item")
    return value


def _split_entry(text: str) -> tuple[str, str | None]:
    """Key and value as written; None where nothing follows the colon."""
    if not (m := _ENTRY.fullmatch(text)):
        raise ValueError("an entry has no colon")
    key, rest = m.groups()
    if not key:
        raise ValueError("an entry has no key")
    if " " in key or "\t" in key:
        raise ValueError("a key holds blanks")
    if not rest:
        return key, None
    if not rest.startswith(" "):
        raise ValueError("a value starts one space after the colon")
    value = rest[1:]
    if not value:
        raise ValueError("a value is empty")
    if value != value.strip(" \t"):
        raise ValueError("a value has blanks around it")
    return key, value


def parse(text: str, options: Options = Options()) -> tuple[list[dict], str]:
    """The entries of a text's header, and its body."""
    # only the header is taken apart into lines, the body is what follows its closing fence
    end = _CLOSING.search(text) if options.require_fence else None
    lines = (text[: end.end()] if end else text).split("\n")
    ended = lines[-1] == ""  # a last line end starts no further line
    count = len(lines) - ended
    at = 0
    if options.require_fence:
        if not count or lines[0].removesuffix("\r") != FENCE:
            raise HeaderError(0, "the opening fence of the header is not there")
        at = 1
    entries: list[dict] = []
    keys: set[str] = set()
    block: list | None = None  # the list or object that indented lines go into
    inner: set[str] = set()
    indent = used = 0
    opened = 0  # line of a key whose block has not begun
    closed = False
    while at < count:
        line, number = lines[at].removesuffix("\r"), at + 1
        at += 1
        if options.require_fence and line == FENCE:
            closed = True
            break
        used += 1
        if options.line_limit and used > options.line_limit:
            raise HeaderError(used, f"the header has more lines than its limit {options.line_limit}")
        bare = line.lstrip(" \t")
        try:
            if bare.startswith("#"):
                raise ValueError(NO_COMMENTS)
            if not bare:
                if block is not None and not opened and entries[-1]["kind"] == "object" and options.strict_objects:
                    raise ValueError("a blank line stands in an object")
                continue
            lead = line[: len(line) - len(bare)]
            if opened:
                if not lead or "\t" in lead:
                    raise ValueError("a key without a value needs indented lines below it")
                kind = "list" if bare.startswith("- ") else "object"
                block, indent, inner, opened = [], len(lead), set(), 0
                entries[-1] |= {"kind": kind, "list" if kind == "list" else "obj": block}
            if block is not None and lead:
                if "\t" in lead:
                    raise ValueError("lines are indented by spaces and not by tabs")
                if len(lead) == indent:
                    if entries[-1]["kind"] == "list":
                        if not bare.startswith("- "):
                            raise ValueError("a list goes on with something that is no item")
                        block.append(_item(bare[2:]))
                        continue
                    key, value = _split_entry(bare)
                    if value is None:
                        raise ValueError("an entry of an object has no value")
                    found = {"key": key, **scalar(value)}
                    if key in inner:
                        raise ValueError("an object has a key twice")
                    inner.add(key)
                    block.append(found)
                    continue
                if len(lead) > indent:
                    raise ValueError("lines of one block are indented alike")
            block = None
            if lead:
                raise ValueError("an indented line belongs to no key")
            key, value = _split_entry(line)
            if key in keys:
                raise ValueError("the header has a key twice")
            keys.add(key)
            entry = {"key": key, "kind": None, "s": None, "i": None, "b": None, "list": None, "obj": None}
            if value is None:
                opened = number
            elif value.startswith("["):
                entry |= {"kind": "list", "list": _inline_list(value)}
            else:
                entry |= scalar(value)
            entries.append(entry)
        except ValueError as wrong:
            raise wrong if isinstance(wrong, HeaderError) else HeaderError(number, str(wrong)) from None
    if opened:
        raise HeaderError(opened, "a key at the end has no value")
    if options.require_fence and not closed:
        raise HeaderError(0, "the closing fence of the header is not there")
    body = text[end.end() + 1 :] if end else "\n".join(lines[at:]) if at < len(lines) else ""
    if options.require_fence and options.trim_body:
        body = re.sub(r"\A(?:\r?\n)+", "", body)
    return entries, body


def _quoted(value: str) -> str:
    """Text as the grammar reads it back: quoted only where it must be."""
    plain = value and value == value.strip() and not set("\n\r\t") & set(value)
    if plain:
        try:
            plain = scalar(value) == {"kind": "string", "s": value, "i": None, "b": None}
        except ValueError:
            plain = False
    if plain:
        return value
    names = {v: f"\\{k}" for k, v in _LETTER_ESCAPES.items()}
    return '"' + "".join(names.get(c) or (c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 0x80 else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}") for c in value) + '"'


def _written(x: dict) -> str:
    if x["kind"] == "string":
        return _quoted(x["s"])
    if x["kind"] == "int":
        return str(x["i"])
    if x["kind"] == "bool":
        return "true" if x["b"] else "false"
    raise ValueError(f"{x['key']}: unsupported scalar kind {x['kind']}")


def check_key(key: str) -> None:
    if not key or set(" \t:\r\n") & set(key):
        raise ValueError(f"invalid key {key!r}")


def serialize(entries: Sequence[dict], fences: bool = True, order: Sequence[str] | None = None, first: Sequence[str] = ()) -> str:
    """A header as text: keys in `order` alone if given (others are left out), else those
    of `first`, then the rest by bytes."""
    by_key = {x["key"]: x for x in entries}
    for named in (order or (), first):
        for key in named:
            check_key(key)
        if len(set(named)) < len(named):
            raise ValueError("duplicate key in key order")
    keys = list(order) if order is not None else [*first, *sorted((k for k in by_key if k not in first), key=str.encode)]
    out = [FENCE] if fences else []
    for key in keys:
        if key not in by_key:
            raise ValueError(f"missing {key}")
        x = by_key[key]
        if x["kind"] == "list":
            if any(not item for item in x["list"]):
                raise ValueError(f"{key}: empty list item")
            out += [f"{key}:", *(f"  - {_quoted(item)}" for item in x["list"])] if x["list"] else [f"{key}: []"]
        elif x["kind"] == "object":
            names = [e["key"] for e in x["obj"]]
            if not names or len(set(names)) < len(names):
                raise ValueError(f"{key}: empty object or duplicate object key")
            out += [f"{key}:", *(f"  {e['key']}: {_written(e)}" for e in sorted(x["obj"], key=lambda e: e["key"].encode()))]
        else:
            out.append(f"{key}: {_written(x)}")
    if fences:
        out.append(FENCE)
    return "".join(x + "\n" for x in out)


def document(entries: Sequence[dict], body: str, first: Sequence[str] = ("id", "schema_version", "title")) -> str:
    """A whole document: reserved keys first, a blank line, the body, one line end."""
    present = {x["key"] for x in entries}
    text = serialize(entries, first=[k for k in first if k in present])
    body = body.lstrip("\r\n") if body else ""
    return text + "\n" + body.rstrip("\n") + "\n" if body else text


def with_header(df: DataFrame, text: str, options: Options = Options()) -> DataFrame:
    """Adds header, body and error (null where the text is well formed) to df."""
    keep = [c for c in df.columns if c not in ("header", "body", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for content in batch.column(text).to_pylist():
                try:
                    out.append((*parse(content or "", options), None))
                except HeaderError as wrong:
                    out.append((None, None, str(wrong)))
            headers, bodies, errors = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(headers, HEADER_ARROW), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], [*keep, "header", "body", "error"]
            )

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep).mapInArrow(run, f"{schema}, header {HEADER_TYPE}, body string, error string")


def with_document(df: DataFrame, header: str, body: str, out: str) -> DataFrame:
    """Adds `out`, the text of the document with that header and body."""
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [document(h, b or "") for h, b in zip(batch.column(header).to_pylist(), batch.column(body).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep).mapInArrow(run, f"{schema}, `{out}` string")


def with_text(df: DataFrame, header: str, out: str, **how) -> DataFrame:
    """Adds `out`, the header as text; how: fences, order and first, as `serialize` takes them."""
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if h is None else serialize(h, **how) for h in batch.column(header).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep).mapInArrow(run, f"{schema}, `{out}` string")


# Typed access: null where the key is missing or has another kind.


def get(header: Column, key: str) -> Column:
    return F.try_element_at(F.filter(header, lambda x: x["key"] == key), F.lit(1))


def has(header: Column, key: str) -> Column:
    return F.exists(header, lambda x: x["key"] == key)


def _of_kind(header: Column, key: str, kind: str, field: str) -> Column:
    found = get(header, key)
    return F.when(found["kind"] == kind, found[field])


def get_string(header: Column, key: str) -> Column:
    return _of_kind(header, key, "string", "s")


def get_int(header: Column, key: str) -> Column:
    return _of_kind(header, key, "int", "i")


def get_bool(header: Column, key: str) -> Column:
    return _of_kind(header, key, "bool", "b")


def get_list(header: Column, key: str) -> Column:
    return _of_kind(header, key, "list", "list")


def get_object(header: Column, key: str) -> Column:
    return _of_kind(header, key, "object", "obj")


def object_value(header: Column, key: str, inner: str) -> Column:
    return F.try_element_at(F.filter(get_object(header, key), lambda x: x["key"] == inner), F.lit(1))


def length(header: Column) -> Column:
    return F.size(header)


def _entry(key: str, kind: str, **values: Column) -> Column:
    types = {"s": "string", "i": "bigint", "b": "boolean", "list": "array<string>", "obj": f"array<struct<key:string,{SCALAR_TYPE}>>"}
    return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), *(values.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))


def string_entry(key: str, value: Column) -> Column:
    return _entry(key, "string", s=value)


def int_entry(key: str, value: Column) -> Column:
    return _entry(key, "int", i=value)


def bool_entry(key: str, value: Column) -> Column:
    return _entry(key, "bool", b=value)


def list_entry(key: str, value: Column) -> Column:
    return _entry(key, "list", list=value)


def set_entry(header: Column, entry: Column) -> Column:
    """header with the entry in the place of one with its key, or at the end."""
    replaced = F.transform(header, lambda x: F.when(x["key"] == entry["key"], entry).otherwise(x))
    return F.when(F.exists(header, lambda x: x["key"] == entry["key"]), replaced).otherwise(F.concat(header, F.array(entry)))
