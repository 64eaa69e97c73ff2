"""Structural rules of the document types over JSON text.

Documents are read as variants, because a typed scan would silently drop unknown members and could
not tell a wrong type from a missing member.  Every rule is a column; items of arrays are rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecensus.functions import fixed_values as V
from pagecensus.functions.columns import CODE_SHAPE, settled, strict_json
from pagecensus.sources.json_ranges import is_long, long_parts

# Closed vocabularies and lexical shapes of document members.
_C0 = V.CONTROL_CLASS.replace("0020", "001F")
LINE_SHAPE = rf"^[^{V.CONTROL_CLASS}](?:[^{_C0}]*[^{V.CONTROL_CLASS}])?\z"
URL_SHAPE = rf"^https?://[^{V.CONTROL_CLASS}]{{1,2040}}\z"
KEY_SHAPE = rf"^https?://[^{V.CONTROL_CLASS}/?#@]{{1,253}}(?:[/?#][^{V.CONTROL_CLASS}]{{0,1790}})?\z"
ORIGIN_SHAPE = rf"^https?://[^{V.CONTROL_CLASS}\\/?#@]{{1,253}}/?\z"
DIGEST_SHAPE = r"^sha256:[0-9a-f]{64}\z"
TIME_SHAPE = (
    r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:"
    r"([0-5][0-9]|60)(\.[0-9]{1,9})?Z\z"
)
POINTER_SHAPE = rf"^(?:/[^{_C0}]*)?\z"
KEYWORD_SHAPE = r"^[A-Za-z$][A-Za-z0-9_]*\z"
COLLECTION_MODES = ["MEASURED", "OBSERVED"]
RESULT_STATES = ["KNOWN", "UNKNOWN", "CONFLICT", "NOT_APPLICABLE"]
NOT_ASSESSED_REASONS = [
    "PROVIDER_FAILURE", "RUNTIME_ERROR", "PERMISSION_DENIED", "TIMEOUT", "UNSUPPORTED", "NOT_REQUESTED",
]
OUTCOMES = [
    "RESPONSE_RECEIVED", "BLOCKED_TARGET", "DNS_FAILURE", "CONNECTION_FAILURE", "TIMEOUT",
    "TOO_MANY_REDIRECTS", "INVALID_REDIRECT", "PROTOCOL_ERROR", "RUNTIME_ERROR",
]
EXCLUSION_REASONS = ["OFF_ORIGIN", "NON_PAGE_RESOURCE", "TARGET_POLICY_REFUSED", "BUDGET_EXHAUSTED", "UNSUPPORTED"]


class Part:
    """One JSON object (a document, a member or an array item) and the rules collected for it."""

    def __init__(self, value: Column, at: Column, names: str, optional: str = "") -> None:
        self.value, self.at, self.rules = value, at, []
        members = names.split()
        everything = members + optional.split()
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        is_object = F.schema_of_variant(value).startswith("OBJECT")
        self.here(~is_object, "type")
        for name in members:
            self.here(is_object & self.raw(name).isNull(), "required")
        self.here(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in everything]))) > 0, "additionalProperties")

    def raw(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$.{name}", "variant")

    def string(self, name: str) -> Column:
        return F.when(F.schema_of_variant(self.raw(name)) == "STRING", F.try_variant_get(self.value, f"$.{name}", "string"))

    def has(self, name: str) -> Column:
        return self.raw(name).isNotNull()

    def here(self, bad: Column, keyword: str) -> None:
        self._add(bad, self.at, keyword)

    def _add(self, bad: Column, pointer: Column, keyword: str) -> None:
        self.rules.append(
            F.when(bad, F.struct(pointer.alias("pointer"), F.lit(keyword).alias("keyword")))
        )

    def _member(self, name: str, bad: Column, keyword: str) -> None:
        self._add(bad, F.concat(self.at, F.lit(f"/{name}")), keyword)

    def typed(self, name: str, kind: str) -> None:
        self._member(name, ~F.schema_of_variant(self.raw(name)).startswith(kind), "type")

    def text(self, name: str, shape: str, longest: list[int], shortest: int = 0) -> None:
        self.typed(name, "STRING")
        text = self.string(name)
        self._member(name, F.length(text) < shortest, "minLength")
        for bound in longest:
            self._member(name, F.length(text) > bound, "maxLength")
        self._member(name, ~text.rlike(shape), "pattern")

    def lines(self, names: str, bound: int = V.MAX_TEXT_LENGTH) -> None:
        for name in names.split():
            self.text(name, LINE_SHAPE, sorted({bound, V.MAX_TEXT_LENGTH}), 1)

    def ids(self, names: str) -> None:
        self.lines(names, 128)

    def codes(self, names: str) -> None:
        for name in names.split():
            self.text(name, CODE_SHAPE, [64], 2)

    def urls(self, names: str, shape: str = URL_SHAPE, bound: int = V.MAX_URL_LENGTH) -> None:
        for name in names.split():
            self.text(name, shape, [bound])

    def times(self, names: str) -> None:
        for name in names.split():
            self.text(name, TIME_SHAPE, [30])

    def digests(self, names: str) -> None:
        for name in names.split():
            self.text(name, DIGEST_SHAPE, [71], 71)

    def choice(self, name: str, values: list[str]) -> None:
        self.typed(name, "STRING")
        self._member(name, self.has(name) & ~F.coalesce(self.string(name).isin(values), F.lit(False)), "enum")

    def version(self) -> None:
        self.typed("schema_version", "STRING")
        stated = F.coalesce(self.string("schema_version") == V.SCHEMA_VERSION, F.lit(False))
        self._member("schema_version", self.has("schema_version") & ~stated, "const")

    def whole(self, name: str, low: int | None = None, high: int | None = None) -> None:
        kind = F.schema_of_variant(self.raw(name))
        number = F.when(
            (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"),
            F.try_variant_get(self.value, f"$.{name}", "double"),
        )
        self._member(name, self.has(name) & F.coalesce(number != F.floor(number), F.lit(True)), "type")
        if low is not None:
            self._member(name, number < low, "minimum")
        if high is not None:
            self._member(name, number > high, "maximum")

    def flag(self, name: str) -> None:
        self.typed(name, "BOOLEAN")

    def only_when(self, condition: Column, names: str, required: bool = True) -> None:
        """Members that must be present under a condition and absent otherwise."""
        holds = F.coalesce(condition, F.lit(False))
        present = [self.has(name) for name in names.split()]
        if required:
            for one in present:
                self.here(holds & ~one, "required")
        anything = present[0]
        for one in present[1:]:
            anything = anything | one
        self.here(~holds & anything, "not")

    def array_bounds(self, name: str, shortest: int = 0, longest: int | None = None, unique: bool = True) -> None:
        items = F.try_variant_get(self.value, f"$.{name}", "array<variant>")
        self.typed(name, "ARRAY")
        if shortest:
            self._member(name, F.size(items) < shortest, "minItems")
        if longest is not None:
            self._member(name, F.size(items) > longest, "maxItems")
        if unique:
            texts = F.transform(items, lambda i: F.to_json(i))
            self._member(name, F.size(F.array_distinct(texts)) < F.size(texts), "uniqueItems")

    def inner(self, name: str, names: str, optional: str = "") -> "Part":
        """The rules of an object member, collected here; they hold only where it is present."""
        part = Part(self.raw(name), F.concat(self.at, F.lit(f"/{name}")), names, optional)
        self.rules.append(part)
        return part

    def columns(self) -> list[Column]:
        flat = []
        for rule in self.rules:
            flat += rule.columns() if isinstance(rule, Part) else [rule]
        return flat


def _assessment(document: Part) -> Column:
    part = document.inner("assessment", "", "collection_mode result_state not_assessed_reason")
    part.choice("collection_mode", COLLECTION_MODES)
    part.choice("result_state", RESULT_STATES)
    part.choice("not_assessed_reason", NOT_ASSESSED_REASONS)
    reason = part.has("not_assessed_reason")
    performed = part.has("collection_mode") | part.has("result_state")
    part.here(reason & performed, "not")
    for name in ("collection_mode", "result_state"):
        part.here(part.value.isNotNull() & ~reason & ~part.has(name), "required")
    return F.coalesce(part.string("result_state") == "KNOWN", F.lit(False))


def analysis_run_request(v: Column, at: Column) -> Part:
    p = Part(v, at, "schema_version run_id request_id requested_at target_url scan_mode", "requester_ref")
    p.version()
    p.ids("run_id request_id requester_ref")
    p.times("requested_at")
    p.urls("target_url")
    p.choice("scan_mode", ["PUBLIC_NON_INVASIVE", "OWNER_VERIFIED_CONTROLLED"])
    return p


def analysis_run_state(v: Column, at: Column) -> Part:
    p = Part(v, at, "schema_version run_id state entered_at", "finished_at failure")
    p.version()
    p.ids("run_id")
    p.choice("state", V.RUN_STATES)
    p.times("entered_at finished_at")
    p.inner("failure", "code").codes("code")
    p.only_when(p.string("state").isin(V.TERMINAL_STATES), "finished_at")
    p.only_when(p.string("state") == "FAILED", "failure")
    return p


def stage_execution_record(v: Column, at: Column) -> Part:
    p = Part(v, at, "schema_version run_id stage_id status started_at", "finished_at")
    p.version()
    p.ids("run_id")
    p.codes("stage_id")
    p.choice("status", ["RUNNING", *V.TERMINAL_STATES])
    p.times("started_at finished_at")
    p.only_when(p.string("status").isin(V.TERMINAL_STATES), "finished_at")
    return p


_CONTEXT = "schema_version run_id source_url observed_at collector collector_version assessment"


def _context(p: Part) -> None:
    p.version()
    p.ids("run_id")
    p.urls("source_url")
    p.times("observed_at")
    p.codes("collector")
    p.lines("collector_version", V.MAX_LABEL_LENGTH)


def measurement_record(v: Column, at: Column) -> Part:
    p = Part(v, at, f"{_CONTEXT} measurement_id metric_id", "result raw_artifact_ref")
    _context(p)
    p.ids("measurement_id raw_artifact_ref")
    p.codes("metric_id")
    p.only_when(_assessment(p), "result")
    r = p.inner("result", "value_type", "boolean_value integer_value text_value url_value")
    r.choice("value_type", ["BOOLEAN", "INTEGER", "TEXT", "URL"])
    r.flag("boolean_value")
    r.whole("integer_value")
    r.lines("text_value")
    r.urls("url_value")
    for kind in ("BOOLEAN", "INTEGER", "TEXT", "URL"):
        r.only_when(r.string("value_type") == kind, f"{kind.lower()}_value")
    return p


def website_evidence(v: Column, at: Column) -> Part:
    p = Part(v, at, f"{_CONTEXT} evidence_id scenario measurement_refs", "polarity")
    _context(p)
    p.ids("evidence_id")
    p.codes("scenario")
    known = _assessment(p)
    p.choice("polarity", ["POSITIVE", "NEGATIVE"])
    p.array_bounds("measurement_refs")
    p._member("measurement_refs", known & (F.size(F.try_variant_get(v, "$.measurement_refs", "array<variant>")) < 1), "minItems")
    p.here(~known & p.has("polarity"), "not")
    return p


def diagnostic_finding(v: Column, at: Column) -> Part:
    texts = "finding_summary business_impact recommended_action limitation"
    p = Part(v, at, f"schema_version run_id finding_id rule_id rule_version finding_class evidence_refs {texts}")
    p.version()
    p.ids("run_id finding_id")
    p.codes("rule_id finding_class")
    p.lines("rule_version", V.MAX_LABEL_LENGTH)
    p.lines(texts)
    p.array_bounds("evidence_refs", shortest=1)
    return p


def site_inventory(v: Column, at: Column) -> Part:
    p = Part(
        v, at,
        "schema_version run_id inventory_id generated_at target_origin discovery_method discovery_method_version "
        "classifier classifier_version sources candidates input_digest output_digest",
    )
    p.version()
    p.ids("run_id inventory_id")
    p.times("generated_at")
    p.urls("target_origin", ORIGIN_SHAPE, V.MAX_ORIGIN_LENGTH)
    p.codes("discovery_method classifier")
    p.lines("discovery_method_version classifier_version", V.MAX_LABEL_LENGTH)
    p.array_bounds("sources", shortest=1, unique=False)
    p.array_bounds("candidates", shortest=1)
    p.digests("input_digest output_digest")
    return p


def _source(v: Column, at: Column) -> Part:
    p = Part(v, at, "source_id outcome candidate_count")
    p.codes("source_id")
    p.choice("outcome", V.SOURCE_OUTCOMES)
    p.whole("candidate_count", low=0)
    count = F.try_variant_get(v, "$.candidate_count", "double")
    admitting = F.coalesce(p.string("outcome").isin(V.ADMITTING_OUTCOMES), F.lit(False))
    p._member("candidate_count", ~admitting & (count != 0), "const")
    return p


def _candidate(v: Column, at: Column) -> Part:
    p = Part(v, at, "url_key observed_forms provenance eligibility", "page_type")
    p.urls("url_key", KEY_SHAPE)
    p.array_bounds("observed_forms", shortest=1)
    p.array_bounds("provenance", shortest=1)
    p.codes("page_type")
    e = p.inner("eligibility", "state", "exclusion_reason")
    e.choice("state", ["ELIGIBLE", "EXCLUDED"])
    e.choice("exclusion_reason", EXCLUSION_REASONS)
    e.only_when(e.string("state") == "EXCLUDED", "exclusion_reason")
    return p


def sampling_manifest(v: Column, at: Column) -> Part:
    p = Part(
        v, at,
        "schema_version run_id sampling_manifest_id generated_at inventory_ref inventory_output_digest policy_id "
        "policy_version mode selection_complete selections exclusions input_digest output_digest",
        "budgets incompleteness",
    )
    p.version()
    p.ids("run_id sampling_manifest_id inventory_ref")
    p.times("generated_at")
    p.codes("policy_id")
    p.lines("policy_version", V.MAX_LABEL_LENGTH)
    p.digests("inventory_output_digest input_digest output_digest")
    p.choice("mode", ["CENSUS", "STRATIFIED_SAMPLE"])
    p.flag("selection_complete")
    p.array_bounds("selections", shortest=1)
    p.array_bounds("exclusions")
    b = p.inner("budgets", "", "max_selected_pages max_candidates_considered")
    b.whole("max_selected_pages", low=1)
    b.whole("max_candidates_considered", low=1)
    b.here(b.value.isNotNull() & ~b.has("max_selected_pages") & ~b.has("max_candidates_considered"), "minProperties")
    i = p.inner("incompleteness", "cause")
    i.choice("cause", ["SELECTION_BUDGET_EXHAUSTED", "SAFETY_LIMIT_REACHED", "RUNTIME_LIMIT_REACHED"])
    p.only_when(F.try_variant_get(v, "$.selection_complete", "boolean") == F.lit(False), "incompleteness")
    p.here((i.string("cause") == "SELECTION_BUDGET_EXHAUSTED") & ~p.has("budgets"), "required")
    return p


def _selection(v: Column, at: Column) -> Part:
    p = Part(v, at, "url_key selection_rank selection_reason stratum")
    p.urls("url_key", KEY_SHAPE)
    p.whole("selection_rank", low=1)
    p.choice("selection_reason", ["SEED", "CENSUS", "STRATUM_QUOTA"])
    p.codes("stratum")
    return p


def _exclusion(v: Column, at: Column) -> Part:
    p = Part(v, at, "reason candidate_count")
    p.choice("reason", ["NOT_SELECTED_BY_POLICY", "SELECTION_BUDGET_EXHAUSTED", "INELIGIBLE_IN_INVENTORY"])
    p.whole("candidate_count", low=1)
    return p


def page_acquisition_record(v: Column, at: Column) -> Part:
    response = "http_status final_url_key redirect_count body_truncated body_decoded"
    p = Part(
        v, at,
        "schema_version run_id acquisition_id sampling_manifest_ref sampling_manifest_output_digest url_key "
        "observation_mode acquisition_method acquisition_method_version acquired_at acquisition_outcome measurement_refs",
        f"{response} body_digest raw_artifact_ref measurements_withheld_reason",
    )
    p.version()
    p.ids("run_id acquisition_id sampling_manifest_ref raw_artifact_ref")
    p.digests("sampling_manifest_output_digest body_digest")
    p.urls("url_key final_url_key", KEY_SHAPE)
    p.choice("observation_mode", ["STATIC_HTTP", "RENDERED_BROWSER"])
    p.codes("acquisition_method")
    p.lines("acquisition_method_version", V.MAX_LABEL_LENGTH)
    p.times("acquired_at")
    p.choice("acquisition_outcome", OUTCOMES)
    p.whole("http_status", low=100, high=999)
    p.whole("redirect_count", low=0)
    p.flag("body_truncated")
    p.flag("body_decoded")
    p.array_bounds("measurement_refs")
    p.choice("measurements_withheld_reason", [V.WITHHELD_REASON])
    answered = F.coalesce(p.string("acquisition_outcome") == "RESPONSE_RECEIVED", F.lit(False))
    for name in response.split():
        p.here(answered & ~p.has(name), "required")
    stated = p.has("body_digest") | p.has("raw_artifact_ref")
    for name in response.split():
        stated = stated | p.has(name)
    p.here(~answered & stated, "not")
    p.only_when(F.try_variant_get(v, "$.body_decoded", "boolean"), "body_digest")
    p.only_when(F.size(F.try_variant_get(v, "$.measurement_refs", "array<variant>")) == 0, "measurements_withheld_reason")
    return p


def problem(v: Column, at: Column) -> Part:
    p = Part(v, at, "schema_version code title detail errors", "run_id")
    p.version()
    p.codes("code")
    p.lines("title", V.MAX_LABEL_LENGTH)
    p.lines("detail")
    p.ids("run_id")
    p.array_bounds("errors", longest=V.MAX_PROBLEM_ERRORS, unique=False)
    return p


def _error(v: Column, at: Column) -> Part:
    p = Part(v, at, "pointer keyword")
    p.text("pointer", POINTER_SHAPE, [512])
    p.text("keyword", KEYWORD_SHAPE, [64], 1)
    return p


def _line_item(bound: int, shape: str, shortest: int) -> Callable[[Column], list[tuple[Column, str]]]:
    def rules(item: Column) -> list[tuple[Column, str]]:
        text = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        return [
            (~(F.schema_of_variant(item) == "STRING"), "type"), (F.length(text) < shortest, "minLength"),
            (F.length(text) > bound, "maxLength"), (~text.rlike(shape), "pattern"),
        ]

    return rules


_ID_ITEM = _line_item(128, LINE_SHAPE, 1)
CONTRACTS = {
    "analysis-run-request": (analysis_run_request, {}, {}),
    "analysis-run-state": (analysis_run_state, {}, {}),
    "stage-execution-record": (stage_execution_record, {}, {}),
    "measurement-record": (measurement_record, {}, {}),
    "website-evidence": (website_evidence, {}, {"measurement_refs": _ID_ITEM}),
    "diagnostic-finding": (diagnostic_finding, {}, {"evidence_refs": _ID_ITEM}),
    "site-inventory": (site_inventory, {"sources": _source, "candidates": _candidate}, {}),
    "sampling-manifest": (sampling_manifest, {"selections": _selection, "exclusions": _exclusion}, {}),
    "page-acquisition-record": (page_acquisition_record, {}, {"measurement_refs": _ID_ITEM}),
    "problem": (problem, {"errors": _error}, {}),
}
_NESTED_TEXTS = {
    "site-inventory": ("candidates", {
        "observed_forms": _line_item(V.MAX_URL_LENGTH, KEY_SHAPE, 0), "provenance": _line_item(64, CODE_SHAPE, 2),
    }),
}


def _found(df: DataFrame, rules: list[Column]) -> DataFrame:
    listed = F.array_compact(F.array(*rules))
    return df.select("run_id", F.explode(listed).alias("e")).select("run_id", "e.pointer", "e.keyword")


def _items(df: DataFrame, value: str, at: Column, name: str) -> DataFrame:
    items = F.try_variant_get(F.col(value), f"$.{name}", "array<variant>")
    return df.select("run_id", at.alias("__above"), F.posexplode(items).alias("__no", "__item")).select(
        "run_id", F.concat("__above", F.lit(f"/{name}/"), F.col("__no").cast("string")).alias("__at"), "__item"
    )


def _text_items(items: DataFrame, rules: Callable) -> DataFrame:
    return _found(items, [
        F.when(bad, F.struct(F.col("__at").alias("pointer"), F.lit(keyword).alias("keyword")))
        for bad, keyword in rules(F.col("__item"))
    ])


def structural_violations(documents: DataFrame, contract: str) -> DataFrame:
    """(run_id, text) -> (run_id, pointer, keyword) of every broken structural rule.

    Text that is no JSON is one violation at the root.  Long texts are taken apart, and their rules
    hold of the parts: the shell has stand-ins for its arrays' items, the items are rows.
    """
    whole, objects, texts = CONTRACTS[contract]
    root = F.lit("")
    short = F.when(~is_long(F.col("text")), strict_json(F.col("text")))
    parsed = settled(documents.where(~is_long(F.col("text"))).select("run_id", short.alias("__doc")), ["__doc"])
    long = long_parts(documents.select(F.col("run_id").alias("name"), "text"))
    roots = parsed
    if long is not None:
        roots = parsed.unionByName(long.shells.select(F.col("name").alias("run_id"), F.col("value").alias("__doc")))
    unreadable = roots.where("__doc is null").select("run_id", root.alias("pointer"), F.lit("json").alias("keyword"))
    found = [unreadable, _found(roots, whole(F.col("__doc"), root).columns())]

    def items(name: str) -> DataFrame:
        rows = _items(parsed, "__doc", root, name)
        if long is None:
            return rows
        at = F.concat(F.lit(f"/{name}/"), F.col("place").cast("string"))
        return rows.unionByName(long.items.where(F.col("member") == name).select(
            F.col("name").alias("run_id"), at.alias("__at"), F.col("value").alias("__item")
        ))

    for name, rules in objects.items():
        held = items(name)
        found.append(_found(held, rules(F.col("__item"), F.col("__at")).columns()))
        nested = _NESTED_TEXTS.get(contract)
        if nested and nested[0] == name:
            for member, item_rules in nested[1].items():
                found.append(_text_items(_items(held, "__item", F.col("__at"), member), item_rules))
    for name, item_rules in texts.items():
        found.append(_text_items(items(name), item_rules))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result
