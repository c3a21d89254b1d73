"""Avro container files, as far as table manifests use them: null and deflate blocks."""

from __future__ import annotations

import json
import struct
import zlib
from io import BytesIO
from typing import Any

MAGIC = b"Obj\x01"
_SCALAR = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}


def _long(source: BytesIO) -> int:
    shift = out = 0
    while True:
        byte = source.read(1)[0]
        out |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (out >> 1) ^ -(out & 1)
        shift += 7


def _put_long(value: int) -> bytes:
    value = (value << 1) ^ (value >> 63)
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _value(source: BytesIO, schema: Any, named: dict[str, Any]) -> Any:
    if isinstance(schema, list):
        return _value(source, schema[_long(source)], named)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _value(source, kind, named)
    if isinstance(schema, dict) and "name" in schema:
        named[schema["name"]] = schema
    match kind:
        case "null":
            return None
        case "boolean":
            return source.read(1) == b"\x01"
        case "int" | "long":
            return _long(source)
        case "float":
            return struct.unpack("<f", source.read(4))[0]
        case "double":
            return struct.unpack("<d", source.read(8))[0]
        case "bytes":
            return source.read(_long(source))
        case "string":
            return source.read(_long(source)).decode()
        case "fixed":
            return source.read(schema["size"])
        case "enum":
            return schema["symbols"][_long(source)]
        case "record":
            return {f["name"]: _value(source, f["type"], named) for f in schema["fields"]}
        case "array" | "map":
            out: list = []
            while (n := _long(source)) != 0:
                if n < 0:
                    n, _ = -n, _long(source)
                for _ in range(n):
                    key = source.read(_long(source)).decode() if kind == "map" else None
                    item = _value(source, schema["values" if kind == "map" else "items"], named)
                    out.append((key, item) if kind == "map" else item)
            return dict(out) if kind == "map" else out
    return _value(source, named[kind], named)


def read(data: bytes) -> tuple[dict[str, bytes], list[dict]]:
    """The file's metadata and records."""
    source = BytesIO(data)
    if source.read(4) != MAGIC:
        raise ValueError("this is no Avro container file")
    meta = _value(source, {"type": "map", "values": "bytes"}, {})
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise ValueError(f"Avro blocks of codec {codec} can't be read")
    sync, out = source.read(16), []
    while head := source.read(1):
        source.seek(-len(head), 1)
        n, size = _long(source), _long(source)
        block = source.read(size)
        block = BytesIO(zlib.decompress(block, -15) if codec == "deflate" else block)
        named: dict[str, Any] = {}
        out += [_value(block, schema, named) for _ in range(n)]
        if source.read(16) != sync:
            raise ValueError("a block doesn't end in the file's mark")
    return meta, out


def _encoded(value: Any, schema: Any) -> bytes:
    if isinstance(schema, list):
        at = next(i for i, s in enumerate(schema) if (s == "null") == (value is None))
        return _put_long(at) + _encoded(value, schema[at])
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _encoded(value, kind)
    match kind:
        case "null":
            return b""
        case "boolean":
            return bytes([bool(value)])
        case "int" | "long":
            return _put_long(value)
        case "float" | "double":
            return struct.pack("<f" if kind == "float" else "<d", value)
        case "bytes" | "string":
            raw = value.encode() if isinstance(value, str) else value
            return _put_long(len(raw)) + raw
        case "record":
            return b"".join(_encoded(value.get(f["name"]), f["type"]) for f in schema["fields"])
        case "array":
            return (_put_long(len(value)) + b"".join(_encoded(v, schema["items"]) for v in value) if value else b"") + b"\x00"
        case "map":
            body = b"".join(_encoded(k, "string") + _encoded(v, schema["values"]) for k, v in value.items())
            return (_put_long(len(value)) + body if value else b"") + b"\x00"
    raise ValueError(f"{kind} can't be written")


def write(schema: dict, records: list[dict], meta: dict[str, str] | None = None, codec: str = "deflate") -> bytes:
    """A container file of one block."""
    sync = bytes(range(16))
    head = {"avro.schema": json.dumps(schema), "avro.codec": codec, **(meta or {})}
    block = b"".join(_encoded(r, schema) for r in records)
    if codec == "deflate":
        packer = zlib.compressobj(wbits=-15)
        block = packer.compress(block) + packer.flush()
    body = _put_long(len(records)) + _put_long(len(block)) + block + sync if records else b""
    return MAGIC + _encoded(head, {"type": "map", "values": "string"}) + sync + body
