"""Canonical documents and their digests.

A document's canonical text is never held whole.  It is a set of fragments, each a short text with
its place in the document; ranges of them are sorted and assembled side by side, and the serial pass
that a digest is by definition sees the few large parts that come out.

Fragment kinds: ``L`` opening or closing text of the document, ``O`` an item of an outer list,
``M`` text inside such an item, ``I`` an item of a list inside it.  Separators depend on neighbouring
kinds only and are added while assembling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import digest_text, instant, stable_id
from pagecensus.session import materialised

PLACE = ["section", "key1", "part", "key2", "key3"]


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def _piece(section: int, kind: str, text: Column, *place: Column | int) -> list[Column]:
    """One fragment; ``place`` is (key1, part, key2, key3) as far as it is needed."""
    key1, part, key2, key3 = [*place, *["", 0, "", ""][len(place):]]
    columns = [section, key1, part, key2, key3, kind, text]
    names = [*PLACE, "kind", "text"]
    return [
        (c if isinstance(c, Column) else F.lit(c)).alias(name) for c, name in zip(columns, names)
    ]


def floating_fields(kind: T.DataType, path: str = "") -> list[str]:
    """Where a schema can hold floating-point numbers; ``*`` stands for an item or a key."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in floating_fields(f.dataType, f"{path}/{f.name}")]
    if isinstance(kind, T.ArrayType):
        return floating_fields(kind.elementType, f"{path}/*")
    if isinstance(kind, T.MapType):
        return floating_fields(kind.keyType, f"{path}/*") + floating_fields(kind.valueType, f"{path}/*")
    return [path or "/"] if isinstance(kind, (T.FloatType, T.DoubleType)) else []


def _fragments(df: DataFrame, *piece: Column) -> DataFrame:
    """Fragments of digested documents: a digest over a floating-point number is not portable."""
    if found := floating_fields(df.schema):
        raise TypeError(f"a digested document must not hold floating-point numbers: {', '.join(found)}")
    return df.select(F.col("run_id").alias("doc_id"), *piece)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def observation_fragments(admitted: DataFrame) -> DataFrame:
    """The admitted observations as one sorted list; runs without any have no document."""
    record = F.to_json(F.struct("label", "observed_form", "source_id"))
    label = F.coalesce("label", F.lit(""))
    runs = admitted.select("run_id").distinct()
    return _union([
        _fragments(runs, *_piece(0, "L", F.lit("["))),
        _fragments(
            admitted,
            *_piece(1, "O", record, F.col("observed_form"), 0, F.col("source_id"), label),
        ),
        _fragments(runs, *_piece(2, "L", F.lit("]"))),
    ])


def _members(names: list[str]) -> Column:
    """Members of a document as JSON text in the given order, without braces."""
    columns = [
        F.lit(V.SCHEMA_VERSION).alias(n) if n == "schema_version"
        else instant(F.col(n)).alias(n) if n == "generated_at"
        else F.col(n)
        for n in names
    ]
    wrapped = F.to_json(F.struct(*columns))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


_INVENTORY_ENVELOPE = [
    "generated_at", "input_digest", "inventory_id", "output_digest", "run_id", "schema_version",
]


def inventory_fragments(
    runs: DataFrame, candidates: DataFrame, forms: DataFrame, sources: DataFrame, attempts: DataFrame,
    whole: bool = False,
) -> DataFrame:
    """The digested part of each inventory.  ``attempts`` carries the candidate counts.

    With ``whole``, ``runs`` are inventory headers and the envelope and digests are part of the text.
    """
    key = F.col("url_key")
    eligibility = F.to_json(
        F.struct("exclusion_reason", F.col("eligibility_state").alias("state"))
    )
    opening = F.concat(F.lit('{"eligibility":'), eligibility, F.lit(',"observed_forms":['))
    page_type = F.when(
        F.col("page_type").isNotNull(), F.concat(F.lit(',"page_type":'), quoted(F.col("page_type")))
    ).otherwise("")
    middle = F.concat(F.lit("]"), page_type, F.lit(',"provenance":['))
    closing = F.concat(F.lit('],"url_key":'), quoted(key), F.lit("}"))
    method = (
        f'],"classifier":"{V.CLASSIFIER}","classifier_version":"{V.CLASSIFIER_VERSION}",'
        f'"discovery_method":"{V.DISCOVERY_METHOD}",'
        f'"discovery_method_version":"{V.DISCOVERY_METHOD_VERSION}",'
    )
    envelope = [_members(_INVENTORY_ENVELOPE), F.lit(",")] if whole else []
    method = F.concat(F.lit(method), *envelope, F.lit('"sources":['))
    source = F.to_json(F.struct("candidate_count", "outcome", "source_id"))
    target = F.concat(F.lit('],"target_origin":'), quoted(F.col("site")), F.lit("}"))
    return _union([
        _fragments(runs, *_piece(0, "L", F.lit('{"candidates":['))),
        _fragments(candidates, *_piece(1, "O", opening, key, 0)),
        _fragments(forms, *_piece(1, "I", quoted(F.col("observed_form")), key, 1, F.col("observed_form"))),
        _fragments(candidates, *_piece(1, "M", middle, key, 2)),
        _fragments(sources, *_piece(1, "I", quoted(F.col("source_id")), key, 3, F.col("source_id"))),
        _fragments(candidates, *_piece(1, "M", closing, key, 4)),
        _fragments(runs, *_piece(2, "L", method)),
        _fragments(attempts, *_piece(3, "O", source, F.col("source_id"))),
        _fragments(runs, *_piece(4, "L", target)),
    ])


def manifest_fragments(summary: DataFrame, selections: DataFrame, exclusions: DataFrame) -> DataFrame:
    """The digested outcome of each manifest, selections in rank order."""
    exclusion = F.to_json(F.struct("candidate_count", "reason"))
    selection = F.to_json(F.struct("selection_rank", "selection_reason", "stratum", "url_key"))
    cause = F.when(
        F.col("incompleteness_cause").isNotNull(),
        F.concat(F.lit('"incompleteness":{"cause":'), quoted(F.col("incompleteness_cause")), F.lit("},")),
    ).otherwise("")
    middle = F.concat(
        F.lit("],"), cause, F.lit('"mode":"CENSUS","selection_complete":'),
        F.col("selection_complete").cast("string"), F.lit(',"selections":['),
    )
    return _union([
        _fragments(summary, *_piece(0, "L", F.lit('{"exclusions":['))),
        _fragments(exclusions, *_piece(1, "O", exclusion, F.col("reason"))),
        _fragments(summary, *_piece(2, "L", middle)),
        _fragments(selections, *_piece(3, "O", selection, rank_key(F.col("selection_rank")))),
        _fragments(summary, *_piece(4, "L", F.lit("]}"))),
    ])


_MANIFEST_ENVELOPE = [
    "input_digest", "inventory_output_digest", "inventory_ref", "mode", "output_digest", "policy_id",
    "policy_version", "run_id", "sampling_manifest_id", "schema_version", "selection_complete",
]


def whole_manifest_fragments(manifests: DataFrame, selections: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Each manifest document with its envelope, budget and digests."""
    opening = F.when(
        F.col("max_selected_pages").isNotNull(),
        F.concat(F.lit('{"budgets":'), F.to_json(F.struct("max_selected_pages")), F.lit(',"exclusions":[')),
    ).otherwise('{"exclusions":[')
    cause = F.when(
        F.col("incompleteness_cause").isNotNull(),
        F.concat(F.lit(',"incompleteness":{"cause":'), quoted(F.col("incompleteness_cause")), F.lit("}")),
    ).otherwise("")
    middle = F.concat(
        F.lit("],"), _members(["generated_at"]), cause, F.lit(","), _members(_MANIFEST_ENVELOPE),
        F.lit(',"selections":['),
    )
    exclusion = F.to_json(F.struct("candidate_count", "reason"))
    selection = F.to_json(F.struct("selection_rank", "selection_reason", "stratum", "url_key"))
    return _union([
        _fragments(manifests, *_piece(0, "L", opening)),
        _fragments(exclusions, *_piece(1, "O", exclusion, F.col("reason"))),
        _fragments(manifests, *_piece(2, "L", middle)),
        _fragments(selections, *_piece(3, "O", selection, rank_key(F.col("selection_rank")))),
        _fragments(manifests, *_piece(4, "L", F.lit("]}"))),
    ])


def rank_key(rank: Column) -> Column:
    """A rank as text whose order is the rank order."""
    return F.lpad(rank.cast("string"), 19, "0")


def list_fragments(documents: DataFrame, order: list[Column], json: Column) -> DataFrame:
    """All documents of one type of a run as one list, in emission order."""
    keys = [*order, F.lit(""), F.lit("")][:3]
    runs = documents.select("run_id").distinct()
    return _union([
        _fragments(runs, *_piece(0, "L", F.lit("["))),
        _fragments(documents, *_piece(1, "O", json, keys[0], 0, keys[1], keys[2])),
        _fragments(runs, *_piece(2, "L", F.lit("]"))),
    ])


def _in_order(fragments: DataFrame) -> DataFrame:
    """Fragments in ranges of (document, place): a large document is read in as many as it fills."""
    ranged = fragments.repartitionByRange(
        int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", *PLACE
    ).sortWithinPartitions("doc_id", *PLACE)
    return ranged.select(F.spark_partition_id().alias("range"), "doc_id", "kind", "text")


#: Characters from which the text of a document so far is given out as a part.
_TEXT_PART = 1 << 20
#: Characters of a row that goes on to the serial hash: a batch holds thousands of rows.
_HASH_PART = 1 << 13
#: Characters of the rows that are given out together.
_BATCH = 1 << 22


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str, str, str]]:
    """(range, document, first kind, last kind, text) of neighbouring fragments of one document.

    What stands between two fragments depends on them alone: items of the outer list follow a comma
    unless they open it, items of an inner list if they follow one another.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        docs = np.array(batch.column("doc_id").to_pylist(), dtype=object)
        kinds = np.array(batch.column("kind").to_pylist())
        fresh = np.append(True, docs[1:] != docs[:-1])
        before = np.append("", kinds[:-1])
        comma = ~fresh & (((kinds == "O") & (before != "L")) | ((kinds == "I") & (before == "I")))
        texts = pc.binary_join_element_wise(pa.array(np.where(comma, ",", ""), pa.string()), batch.column("text"), "")
        begin = np.flatnonzero(fresh)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, len(docs)), pa.int32()), texts), "")
        last = np.append(begin[1:], len(docs)) - 1
        number = batch.column("range")[0].as_py()
        yield from zip([number] * len(begin), docs[begin], kinds[begin], kinds[last], joined.to_pylist())


def _comma(last: str | None, first: str) -> str:
    """What stands between a document's text so far, ending in kind ``last``, and the next."""
    return "," if (first == "O" and last not in (None, "L")) or (first == "I" and last == "I") else ""


def _assembled(hashed: bool):
    """Per range: the digests (or texts) of the short documents that lie in it, and the parts of all others.

    The first document of a range may have begun before it and the last may go on; what joins their
    parts is decided by the parts' first and last kinds.
    """
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        document, number, opens, first, last, pending, size, held = None, 0, True, "", "", [], 0, 0

        def end(done: bool) -> None:
            nonlocal number, pending, size, held
            text = "".join(pending)
            if done and not number and not opens:
                whole = "sha256:" + hashlib.sha256(text.encode()).hexdigest() if hashed else text
                rows.append((document, place, 0, None, None, None, whole))
            else:
                # Nothing stands between the rows of one part: a row that goes on has no first kind.
                step = _HASH_PART if hashed else max(len(text), 1)
                for at in range(0, max(len(text), 1), step):
                    rows.append((document, place, number, "" if at else first, last, text[at : at + step], None))
                    number += 1
                number -= 1
            number, pending, size, held = number + 1, [], 0, held + len(text)

        def flushed() -> pa.RecordBatch:
            nonlocal held
            held = 0
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.record_batch(columns, names=["doc_id", "range", "part", "first", "last", "text", "whole"])

        place, seen = 0, 0
        for place, doc_id, head, tail, text in _stretches(batches):
            if doc_id != document:
                if document is not None:
                    end(done=True)
                opens, seen = seen == 0, seen + 1
                document, number = doc_id, 0
            elif size >= _TEXT_PART:
                end(done=False)
            if pending:
                pending.append(_comma(last, head))
            else:
                first = head
            pending.append(text)
            last, size = tail, size + len(text)
            if len(rows) >= 1000 or held >= _BATCH:
                yield flushed()
        if document is not None:
            end(done=False)  # it may go on in the next range
        if rows:
            yield flushed()

    return each


def _parts(fragments: DataFrame, hashed: bool) -> DataFrame:
    columns = "doc_id string, range int, part int, first string, last string, text string, whole string"
    return materialised(_in_order(fragments).mapInArrow(_assembled(hashed), columns))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    document, state, last, found = None, None, None, []
    for batch in batches:
        for row in zip(*batch.columns):  # one row at a time is Python objects
            doc_id, first, ends, text = (v.as_py() for v in row)
            if doc_id != document:
                if state is not None:
                    found.append((document, "sha256:" + state.hexdigest()))
                document, state, last = doc_id, hashlib.sha256(), None
            state.update((_comma(last, first) + text).encode("utf-8"))
            last = ends
    if state is not None:
        found.append((document, "sha256:" + state.hexdigest()))
    if found:
        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*found)], names=["doc_id", "digest"])


def streamed_digests(fragments: DataFrame) -> DataFrame:
    """(doc_id, digest) of every document.

    Ranges assemble their fragments side by side; a document that one range holds is hashed there,
    of the others the serial hash sees their parts in short rows.
    """
    parts = _parts(fragments, hashed=True)
    long = parts.where("whole is null").repartition("doc_id").sortWithinPartitions("doc_id", "range", "part")
    hashed = long.select("doc_id", "first", "last", "text").mapInArrow(_digest_batches, "doc_id string, digest string")
    return parts.where("whole is not null").select("doc_id", F.col("whole").alias("digest")).unionByName(hashed)


def document_texts(fragments: DataFrame) -> DataFrame:
    """The canonical text of every document, in numbered parts of up to about a million characters.

    A part ends where a range does, so a short document may have two.
    """
    parts = _parts(fragments, hashed=False)
    order = Window.partitionBy("doc_id").orderBy("range", "part")
    # Narrow rows: as many per document as its text has parts.
    placed = parts.where("whole is null").select("doc_id", "range", "part", F.lag("last").over(order).alias("before"), (F.row_number().over(order) - 1).cast("long").alias("part_no"))
    first = F.col("first")
    comma = F.when(((first == "O") & (F.col("before") != "L")) | ((first == "I") & (F.col("before") == "I")), ",").otherwise("")
    joined = parts.join(placed, ["doc_id", "range", "part"]).select("doc_id", "part_no", F.concat(comma, "text").alias("text"))
    return parts.where("whole is not null").select("doc_id", F.lit(0).cast("long").alias("part_no"), F.col("whole").alias("text")).unionByName(joined)


def inventory_digests(
    runs: DataFrame, admitted: DataFrame, candidates: DataFrame, forms: DataFrame,
    sources: DataFrame, attempts: DataFrame,
) -> DataFrame:
    """(run_id, input_digest, output_digest) of every inventory, both in one shuffle."""
    tagged = [
        observation_fragments(admitted).withColumn("doc_id", F.concat(F.lit("i|"), "doc_id")),
        inventory_fragments(runs, candidates, forms, sources, attempts).withColumn(
            "doc_id", F.concat(F.lit("o|"), "doc_id")
        ),
    ]
    digests = streamed_digests(_union(tagged))
    which = F.substring("doc_id", 1, 1)
    return digests.groupBy(F.expr("substring(doc_id, 3)").alias("run_id")).agg(
        F.max(F.when(which == "i", F.col("digest"))).alias("input_digest"),
        F.max(F.when(which == "o", F.col("digest"))).alias("output_digest"),
    )


def inventories(runs: DataFrame, digests: DataFrame) -> DataFrame:
    """Inventory headers.  ``runs`` carries run_id, site and generated_at."""
    return runs.join(digests, "run_id").select(
        "run_id", stable_id("i", F.col("run_id")).alias("inventory_id"), "generated_at",
        F.col("site").alias("target_origin"),
        F.lit(V.DISCOVERY_METHOD).alias("discovery_method"),
        F.lit(V.DISCOVERY_METHOD_VERSION).alias("discovery_method_version"),
        F.lit(V.CLASSIFIER).alias("classifier"),
        F.lit(V.CLASSIFIER_VERSION).alias("classifier_version"),
        "input_digest", "output_digest",
    )


def manifest_input_digest() -> Column:
    """Over the bound inventory, the policy and the declared budget of one manifest row."""
    budgets = F.when(
        F.col("max_selected_pages").isNotNull(), F.struct("max_selected_pages")
    ).alias("budgets")
    return digest_text(
        F.to_json(
            F.struct(budgets, "inventory_output_digest", "inventory_ref", "policy_id", "policy_version")
        )
    )


def manifests(summary: DataFrame, output_digests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest headers bound to their inventory by identity and digest."""
    bound = summary.join(
        inventory.select(
            "run_id", "generated_at", F.col("inventory_id").alias("inventory_ref"),
            F.col("output_digest").alias("inventory_output_digest"),
        ),
        "run_id",
    ).join(output_digests.select(F.col("doc_id").alias("run_id"), F.col("digest")), "run_id")
    return bound.withColumns({
        "policy_id": F.lit(V.POLICY_ID), "policy_version": F.lit(V.POLICY_VERSION),
    }).select(
        "run_id", stable_id("s", F.col("run_id")).alias("sampling_manifest_id"), "generated_at",
        "inventory_ref", "inventory_output_digest", "policy_id", "policy_version",
        "max_selected_pages", F.lit("CENSUS").alias("mode"), "selection_complete",
        "incompleteness_cause", "candidate_count", "selected_count",
        manifest_input_digest().alias("input_digest"), F.col("digest").alias("output_digest"),
    )
