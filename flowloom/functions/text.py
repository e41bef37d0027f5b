"""Flows as text: descriptions, instruction records, prompts, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.functions.formatting import fmt4, py_repr
from flowloom.functions.labels import binary_label
from flowloom.schemas import q

# The wording of the text formats.
INPUT_PREFIX = "Network flow features: "
INSTRUCTION = (
    "Classify the following network traffic flow based on its characteristics. The possible classes are: "
    + ", ".join(S.CLASSES) + "."
)
EXPERT = "You are a network security expert. Analyze the following network flow and classify the traffic type.\n\n"
CHAT_SYSTEM = "You are a helpful assistant specialized in network security analysis."
CHAT_QUESTION = "What type of network traffic or attack is this?"
MAX_CHARACTERS = 400
FLAG_NAMES = {f"{f.lower()}_flag_number": f for f in ("FIN", "SYN", "RST", "PSH", "ACK", "ECE", "CWR")}
COUNT_NAMES = {f"{f.lower()}_count": f for f in ("ACK", "SYN", "FIN", "URG", "RST")}
SERVICES = [
    "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP", "ARP", "ICMP", "IPv", "LLC",
]
RATE_NAMES = {"Rate": "overall", "Srate": "source", "Drate": "destination"}
PROTOCOL_TYPES = {6: "TCP", 17: "UDP", 1: "ICMP"}
# column, word, whether any value but 0 is shown (else only positive ones)
STATISTICS = [
    ("Tot sum", "total sum", False), ("Tot size", "total size", False), ("Min", "minimum", True),
    ("Max", "maximum", False), ("AVG", "average", False), ("Std", "standard deviation", False),
]
ADVANCED = [
    ("IAT", "inter-arrival time", False), ("Number", "number", False), ("Magnitue", "magnitude", False),
    ("Radius", "radius", False), ("Covariance", "covariance", True), ("Variance", "variance", False),
    ("Weight", "weight", False),
]


def _raw(df: DataFrame, name: str) -> Column:
    """The column as a double; 0 where the table does not have it."""
    return F.col(q(name)).cast("double") if name in df.columns else F.lit(0.0)


def _known(x: Column) -> Column:
    """NaN as NULL: Spark takes NaN for larger than any number."""
    return F.nanvl(x, F.lit(None).cast("double"))


def _whole(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def _shown(x: Column) -> Column:
    return F.coalesce(fmt4(x), F.lit("nan"))


def _joined(title: str, items: list[Column]) -> Column:
    """The title and the items that are not NULL, joined by commas; NULL if there are none."""
    return F.concat(F.lit(f"{title}: "), F.nullif(F.concat_ws(", ", *items), F.lit("")))


def _counted(df: DataFrame, title: str, names: dict[str, str], suffix: str = "") -> Column:
    columns = [(_raw(df, c), word) for c, word in names.items()]
    return _joined(title, [F.when(_known(x) > 0, F.concat(_whole(x), F.lit(f" {word}{suffix}"))) for x, word in columns])


def _measures(df: DataFrame, title: str, rules: list[tuple[str, str, bool]]) -> Column:
    """Values by rule; a missing value differs from 0."""
    items = []
    for c, word, any_value in rules:
        x = _known(_raw(df, c))
        show = F.coalesce(x != 0, F.lit(True)) if any_value else x > 0
        items.append(F.when(show, F.concat(F.lit(f"{word} "), _shown(x))))
    return _joined(title, items)


def verbalise(df: DataFrame) -> Column:
    """A flow as sentences joined by ". ". One expression, no Python per row.

    A lambda, and all that is inside it, is evaluated node by node, so only rare numbers are printed by one (:func:`fixed`). As a step that
    holds a lambda is not part of its stage's method, its code comes in methods that the JIT compiler takes.
    """
    duration, total, header = (_known(_raw(df, c)) for c in ("flow_duration", "Duration", "Header_Length"))
    protocol = _known(_raw(df, "Protocol Type"))
    named = F.when(protocol > 0, F.concat(F.lit("protocol "), _whole(protocol)))
    for number, name in PROTOCOL_TYPES.items():
        named = F.when(protocol == number, F.lit(f"{name} protocol")).otherwise(named)
    other_total = (total > 0) & F.coalesce(total != duration, F.lit(True))
    rates = [(_known(_raw(df, c)), word) for c, word in RATE_NAMES.items()]
    return F.concat_ws(
        ". ",
        F.concat(F.lit("Network flow with duration "), _shown(duration), F.lit(" seconds")),
        F.when(other_total, F.concat(F.lit("total duration "), _shown(total))),
        F.when(header > 0, F.concat(F.lit("header length "), _whole(header), F.lit(" bytes"))),
        F.concat(F.lit("using "), named),
        *[F.when(x > 0, F.concat(F.lit(f"{word} rate "), _shown(x))) for x, word in rates],
        _counted(df, "TCP flags", FLAG_NAMES),
        _counted(df, "Flag counts", COUNT_NAMES, " count"),
        _joined("Services", [F.when(_known(_raw(df, c)) > 0, F.lit(c)) for c in SERVICES]),
        _measures(df, "Statistics", STATISTICS),
        _measures(df, "Advanced metrics", ADVANCED),
    )


def truncate(text: Column, limit: int = MAX_CHARACTERS) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substr(text, F.lit(1), F.lit(limit)), F.lit("..."))).otherwise(text)


def text_table(df: DataFrame, label: str = S.LABEL, keep: list[str] | None = None) -> DataFrame:
    """``text, label, binary_label`` of the rows that have a label. The full text is built once, then cut."""
    rows = df.na.drop(subset=[label])
    keep = keep or []
    full = rows.select(*[q(c) for c in keep], verbalise(rows).alias("_full"), F.trim(F.col(q(label)).cast("string")).alias("_label"))
    return full.select(
        *[q(c) for c in keep], truncate(F.col("_full")).alias("text"), F.col("_label").alias("label"),
        binary_label(F.col("_label")).alias("binary_label"),
    )


# ---- instruction records -----------------------------------------------------------------------


def printed_values(df: DataFrame, fields: list[T.StructField]) -> Column:
    """All values as an array of texts.

    Doubles are printed by one lambda over their array: 46 copies of the
    printing rules would not fit the generated code of a stage.
    """
    fractional = (T.DoubleType, T.FloatType)
    numbers = [f.name for f in fields if isinstance(f.dataType, fractional)]
    texts = F.transform(
        F.array(*[F.col(q(c)).cast("double") for c in numbers]), lambda x: F.coalesce(py_repr(x), F.lit("nan"))
    ) if numbers else None
    if len(numbers) == len(fields):
        return texts
    return F.array(*[
        F.element_at(texts, numbers.index(f.name) + 1) if f.name in numbers
        else F.coalesce(F.col(q(f.name)).cast("string"), F.lit("None"))
        for f in fields
    ])


def instruction_records(df: DataFrame, label: str = S.LABEL, keep: list[str] | None = None) -> DataFrame:
    """``instruction, input, output`` with the features in column order."""
    keep = keep or []
    fields = [f for f in df.schema.fields if f.name != label and f.name not in keep]
    names = F.array(*[F.lit(f.name) for f in fields])
    pairs = F.zip_with(names, printed_values(df, fields), lambda name, text: F.concat(name, F.lit(": "), text))
    return df.select(
        *[q(c) for c in keep],
        F.lit(INSTRUCTION).alias("instruction"),
        F.concat(F.lit(INPUT_PREFIX), F.array_join(pairs, ", ")).alias("input"),
        F.col(q(label)).cast("string").alias("output"),
    )


def prompt(instruction: Column, text: Column, output: Column | None = None, end: str = "") -> Column:
    """The record as one prompt; with ``output`` and ``end`` for training."""
    parts = [F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), text, F.lit("\n\n### Response:\n")]
    return F.concat(*parts, *([] if output is None else [output, F.lit(end)]))


def expert_prompt(text: Column, label: Column) -> Column:
    return F.concat(F.lit(f"{EXPERT}Network Flow: "), text, F.lit("\n\nAnswer: "), label, F.lit(" "))


def chat_prompt(text: Column, label: Column) -> Column:
    """System, user and assistant turns with their header tokens."""

    def turn(role: str) -> str:
        return f"<|start_header_id|>{role}<|end_header_id|>\n\n"

    return F.concat(
        F.lit(f"<|begin_of_text|>{turn('system')}{CHAT_SYSTEM}<|eot_id|>{turn('user')}{EXPERT}Network Flow: "), text,
        F.lit(f"\n\n{CHAT_QUESTION}<|eot_id|>{turn('assistant')}"), label, F.lit("<|eot_id|>"),
    )


# ---- parsing -----------------------------------------------------------------------------------


def parse_features(text: Column) -> Column:
    """``name -> value text``; pairs without ": " are ignored, of equal names the last one wins.

    The text is cut once. Texts with a repeated name are rare; only they pay for looking for the last one.
    """
    body = F.replace(text, F.lit(INPUT_PREFIX), F.lit(""))

    def entry(p: Column) -> Column:
        key = F.substring_index(p, ": ", 1)
        return F.struct(key.alias("key"), F.substr(p, F.length(key) + 3, F.length(p)).alias("value"))

    def as_map(entries: Column) -> Column:
        names = F.transform(entries, lambda e: e["key"])
        last = F.filter(entries, lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]
        ))
        return F.map_from_entries(F.when(F.size(F.array_distinct(names)) < F.size(entries), last).otherwise(entries))

    entries = F.transform(F.filter(F.split(body, ", "), lambda p: F.contains(p, F.lit(": "))), entry)
    return F.get(F.transform(F.array(entries), as_map), F.lit(0))


def feature_numbers(features: Column, names: list[str]) -> Column:
    """The parsed values of ``names`` as an array of numbers, NULL where there is none.

    One lambda for all names: a lookup per column is more code than the JIT compiler takes. A name is first looked for at its own place,
    where records that were made in this order have it. Select with ``element_at``, before which Spark keeps the array as a step of its own.
    """
    def value(name: Column, i: Column) -> Column:
        here = F.get(F.map_keys(features), i) == name
        return F.when(here, F.get(F.map_values(features), i)).otherwise(F.try_element_at(features, name)).try_cast("double")

    return F.transform(F.array(*[F.lit(n) for n in names]), value)


def feature_number(features: Column, name: str) -> Column:
    """A parsed value as a number, NULL when it is not one."""
    return F.try_element_at(features, F.lit(name)).try_cast("double")


def render_features(features: Column) -> Column:
    """Back to text. Every number prints as a double (1 becomes 1.0), other values as they are."""
    parts = F.transform(F.map_entries(features), lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(py_repr(e["value"].try_cast("double")), e["value"])))
    return F.array_join(parts, ", ")


def first_token(text: Column) -> Column:
    token = F.regexp_extract(text, r"\S+", 0)
    return F.when(F.coalesce(token, F.lit("")) == "", F.lit("Unknown")).otherwise(token)


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens of a whole text."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def length_budget(text: Column, n: int) -> Column:
    """The first ``n`` whitespace-separated tokens."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.array_join(F.slice(tokens, 1, n), " ")
