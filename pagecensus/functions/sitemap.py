"""Sitemap documents: an Arrow UDF gives the texts of location elements by their paths; what a
sitemap is, and which locations count, are columns.

Spark's ``xpath`` fails the job on malformed XML and expands entities; here a hostile document is
one that is not whole.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pagecensus.functions.columns import settled, stripped
from pagecensus.functions.content import in_slices, unzipped

_ARROW_TYPE = pa.struct([
    ("root", pa.string()), ("whole", pa.bool_()), ("declares_types", pa.bool_()),
    ("places", pa.list_(pa.struct([("path", pa.string()), ("texts", pa.list_(pa.string()))]))),
])
# Where a location stands, per root element.
_LOCATION_OF_ROOT = {"urlset": "urlset/url/loc", "sitemapindex": "sitemapindex/sitemap/loc"}
#: Elements below the one a location may stand in.
_DEPTH = max(path.count("/") for path in _LOCATION_OF_ROOT.values())


class _TypesDeclared(ValueError):
    """A document type declaration, which no sitemap needs and entities come from."""


class _Place:
    """A path of a document: the places below it by name and, of a location, its texts in order."""

    __slots__ = ("path", "below", "texts")

    def __init__(self, path: str, location: bool) -> None:
        self.path, self.below, self.texts = path, {}, [] if location else None


class _LocationTexts:
    """Target of an XML parser; holds the distinct paths, the open ones and the texts of locations.

    Elements too deep for a location share two places, so a document of any depth has few.
    """

    def __init__(self):
        self.root, self.here, self.open, self.places, self.parts = None, _Place("", False), [], [], []
        self.deep = {location: _Place("", location) for location in (False, True)}

    def doctype(self, *_names):
        raise _TypesDeclared

    def start(self, name, _attributes):
        here = self.here
        self.open.append(here)
        self.here = here = here.below.get(name) or self.place(name)
        if here.texts is not None:
            self.parts = []

    def place(self, name):
        """The place of a name seen here for the first time; its namespace makes no difference."""
        above, local = self.here, name[name.find("}") + 1 :]
        self.root = self.root or local
        found = above.below.get(local)
        if found is None and len(self.open) > _DEPTH + 1:
            found = self.deep[local == "loc"]
        elif found is None:
            path = f"{above.path}/{local}" if above.path else local
            found = _Place(path, path.endswith("/loc"))
            self.places.append(found)
        above.below[local] = above.below[name] = found
        return found

    def data(self, text):
        if self.here.texts is not None:
            self.parts.append(text)

    def end(self, _name):
        if self.here.texts is not None:
            self.here.texts.append("".join(self.parts))
        self.here = self.open.pop()


def location_texts(xml: bytes) -> dict:
    """Root and location texts of a document, as far as it is well formed."""
    target = _LocationTexts()
    parser = ElementTree.XMLParser(target=target)
    whole = declares = False
    try:
        parser.feed(xml)
        parser.close()
        whole = True
    except _TypesDeclared:
        declares = True
    except (ElementTree.ParseError, LookupError, ValueError):
        pass
    places = [{"path": p.path, "texts": p.texts} for p in target.places if p.texts]
    return {"root": target.root, "whole": whole, "declares_types": declares, "places": places}


@F.arrow_udf(from_arrow_type(_ARROW_TYPE))
def _location_texts(xml: pa.Array) -> pa.Array:
    return in_slices(location_texts, _ARROW_TYPE, xml)


def with_sitemap(df: DataFrame, body: Column, truncated: Column) -> DataFrame:
    """Adds ``sitemap``: root, verdict and locations of a document; null for a null body."""
    packed = F.substring(body, 1, 2) == F.unhex(F.lit("1F8B"))
    df = df.withColumns({"__cut": F.coalesce(truncated, F.lit(False)), "__packed": packed})
    df = df.withColumn("__xml", F.when(F.col("__packed"), unzipped(F.when(F.col("__packed"), body))).otherwise(body))
    df = settled(df.withColumn("__read", _location_texts(F.col("__xml"))).drop("__xml"), ["__read"])
    root = F.col("__read.root")
    place = F.create_map(*[F.lit(x) for pair in _LOCATION_OF_ROOT.items() for x in pair])
    at_place = F.filter("__read.places", lambda p: p["path"] == F.try_element_at(place, root))
    texts = F.filter(F.transform(F.get(at_place, F.lit(0))["texts"], stripped), lambda t: t != "")
    df = df.withColumn("__found", F.coalesce(texts, F.array().cast("array<string>")))
    found = F.col("__found")
    known = root.isNull() | root.isin(list(_LOCATION_OF_ROOT))
    usable = ~F.col("__read.declares_types") & known & (F.col("__read.whole") | F.col("__cut"))
    verdict = (
        F.when(F.col("__read").isNull(), F.when(F.col("__cut"), "BUDGET_EXHAUSTED").otherwise("MALFORMED"))
        .when(~usable, "MALFORMED")
        .when(F.col("__cut"), "BUDGET_EXHAUSTED")
        .when(F.size(found) > 0, "USED")
        .otherwise("EMPTY")
    )
    facts = F.struct(
        F.when(~F.coalesce("__read.declares_types", F.lit(False)), root).alias("root"), verdict.alias("verdict"),
        F.when(F.coalesce(usable, F.lit(False)), found).otherwise(F.array().cast("array<string>")).alias("locs"),
    )
    read = F.col("__read").isNotNull() | F.coalesce("__packed", F.lit(False))
    return df.withColumn("sitemap", F.when(read, facts)).drop("__cut", "__packed", "__read", "__found")
