"""Bytes to text and relative to absolute: what the JVM has no function for, as small Arrow UDFs.

Which rows visit them, with which arguments, and what a null means is decided in columns.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Callable
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecensus.functions.columns import lookup

# The encodings that can be undone, with the stream format their name stands for.
_GZIP, _ZLIB, _BARE = 31, 15, -15
_FORMAT = {"gzip": str(_GZIP), "x-gzip": str(_GZIP), "deflate": str(_ZLIB)}
_PIECE = 1 << 20
#: What one value of a table can hold; a stream beyond it cannot be given out.
_LARGEST = (1 << 31) - 64

#: Rows of a batch that are Python objects at a time.
_SLICE = 64


def in_slices(read: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``read`` of every row whose first value is not null, as one array.

    A batch may hold ten thousand documents, and what is read off one takes far more memory as
    objects than packed: rows are packed slice by slice, and a document is an object while it is read.
    """
    done = []
    for at in range(0, len(columns[0]), _SLICE):
        rows = zip(*(c.slice(at, _SLICE) for c in columns))
        done.append(pa.array([read(*(v.as_py() for v in r)) if r[0].is_valid else None for r in rows], type=kind))
    return pa.concat_arrays(done) if done else pa.array([], type=kind)


def unpacked(stream: bytes, form: int) -> bytes | None:
    """A packed stream as far as it goes; null if it is none of this form, or empty."""
    reader, out, size = zlib.decompressobj(form), [], 0
    try:
        for at in range(0, len(stream), _PIECE):
            out.append(reader.decompress(stream[at : at + _PIECE]))
            size += len(out[-1])
            if size > _LARGEST:
                return None
    except zlib.error:
        return None
    return b"".join(out) or None


@F.arrow_udf(T.BinaryType())
def unpacked_as(stream: pa.Array, form: pa.Array) -> pa.Array:
    return in_slices(lambda s, f: None if f is None else unpacked(s, f), pa.binary(), stream, form)


def undone_content(wire: Column, encoding: Column) -> Column:
    """Wire bytes without their content encoding; null where it cannot be undone.

    A stream that is not of the form its name stands for may still be the same without a header.
    """
    form = lookup(_FORMAT, encoding).cast("int")
    named = unpacked_as(wire, form)
    return F.coalesce(named, unpacked_as(F.when(form.isNotNull() & named.isNull(), wire), F.lit(_BARE)))


def unzipped(body: Column) -> Column:
    """The content of a gzip file; null if it is none."""
    return unpacked_as(body, F.lit(_GZIP))


def decode(body: bytes, charset: str | None) -> str:
    """Text of a body: the declared charset if it exists, else UTF-8; bad bytes are replaced."""
    name = "utf-8"
    if charset:
        try:
            codecs.lookup(charset)
            name = charset
        except LookupError:
            pass
    text = body.decode(name, errors="replace")
    # A declared charset may yield lone surrogates, which no Arrow string can hold.
    return text if name == "utf-8" else text.encode("utf-8", "replace").decode("utf-8")


def join_url(base: str, target: str) -> str | None:
    try:
        return urljoin(base, target)
    except ValueError:
        return None


@F.arrow_udf(T.StringType())
def decoded_text(body: pa.Array, charset: pa.Array) -> pa.Array:
    """Text of a body in a declared charset; bad bytes are replaced, an unknown charset is UTF-8."""
    return in_slices(decode, pa.string(), body, charset)


@F.arrow_udf(T.ArrayType(T.StringType()))
def joined_urls(base: pa.Array, targets: pa.Array) -> pa.Array:
    """Each target resolved against the base; null for one no URL parser reads."""
    return in_slices(lambda found, b: [join_url(b or "", t) for t in found], pa.list_(pa.string()), targets, base)
