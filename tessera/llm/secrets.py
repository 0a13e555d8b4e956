"""Secret scans with corpus-wide ownership frequency.

A pass over the whole texts finds candidates and keeps their places and hashes, never their plain values. Candidate
hashes are then counted by distinct repositories (documents) and owners (sources): what many owners share is a widely
copied example, what one owner alone has looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidy

#: The base kinds, in their order; a match counts if the part named has so many characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE_KINDS = ("assign", "access", "hex")
#: A private key: up to its END line, else as far as its lines of base64 go. The body alone names the key.
PEM = re.compile(
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:(?P<body>(?:(?!-----BEGIN )[\s\S])*?)-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?P<rest>(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:(?:\s|\\[nr]|[\"'>|#*,])*+(?:[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++={1,2}+|[A-Za-z0-9+/]++(?=\s*\Z)))*+))"
)
#: Further kinds, with a text that a match contains.
MORE = {
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{20,}")),
    "jwt": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}")),
    "pem": ("PRIVATE KEY", PEM),
    "slack": ("xox", re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}")),
    "service": ("k_", re.compile(r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}")),
    "url": ("://", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]{6,}@")),
}
KINDS = (*BASE_KINDS, *MORE)
#: (owners, repositories): a candidate that so many distinct owners share, in so many distinct repositories, is an example.
#: The fewer owners, the more repositories it takes; what one owner alone has is live in however many.
EXAMPLES = ((3, 3), (2, 8))

_HEX_RUN = re.compile(r"[0-9a-f]{24}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _value(m: re.Match) -> str:
    """What names the candidate: the whole match, of a private key its body however its lines are broken."""
    if m.re is not PEM:
        return m[0]
    return re.sub(r"""\s|\\[nr]|["'>|#*,]""", "", m["body"] or m["rest"] or "") or m[0]


def candidates(text: str) -> list[tuple[int, int, int, str, int]]:
    """(start, kind's number, end, value, value's start) of all candidates in the text, by start, then kind.

    Leftmost and non-overlapping for each kind; too short matches are dropped after they have been passed over.
    """
    found = []
    low = text.lower()
    # Case folding of the pattern is ASCII only, so its words are in the lower-cased text of any match.
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2], m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0], m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN.search(text):
        found += [(m.start(), 2, m.end(), m[0], m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    for k, (part, pattern) in enumerate(MORE.values(), len(BASE_KINDS)):
        if part in text:
            found += [(m.start(), k, m.end(), _value(m), m.start()) for m in pattern.finditer(text)]
    return sorted(found)


def _span(start: int, kind: int, end: int) -> str:
    return f"{KINDS[kind]}:{start}:{end}"


_FOUND = "array<struct<start:int,kind:int,end:int,at:int,hash:string>>"


def scanned(docs: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    """``extra`` columns of ``docs`` and its ``place`` with counts, base_sha256 and ``found``, the candidates in the whole text; null is empty."""
    schema = docs.select(*extra).schema
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, "long")
    schema = schema.add("place", "long").add("base_sha256", "string").add("found", docs.sparkSession.range(0).selectExpr(f"cast(null as {_FOUND}) x").schema["x"].dataType)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("hash", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists = [[], [], []], [], []
            for t in batch.column("text"):
                spans = candidates(t.as_py() or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(",".join(_span(*s[:3]) for s in spans if s[1] < 3).encode()).hexdigest())
                lists.append(
                    [{"start": s, "kind": k, "end": e, "at": at, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for s, k, e, v, at in spans]
                )
            columns = [*(batch.column(c) for c in extra), *(pa.array(c, pa.int64()) for c in counts), batch.column("place"), pa.array(digests, pa.string()), pa.array(lists, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*extra, "text", "place").mapInArrow(tidy(run), schema)


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate hash the distinct repositories and owners that hold it, from rows of hash, repository, owner."""
    return found.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))


def classified(rows: DataFrame, owner: str, repository: str) -> DataFrame:
    """A row for each candidate: place, start, kind, end, at, hash, ``example``.

    ``rows``: of ``scanned``, as a table. Only rows with candidates are shuffled, and of those no text. A null owner or
    repository isn't counted.
    """
    each = rows.where(F.size("found") > 0).select(
        "place", F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.inline("found")
    )
    shared = F.lit(False)
    for owners, repositories in EXAMPLES:
        shared = shared | ((F.col("owners") >= owners) & (F.col("repositories") >= repositories))
    copied = ownership(each.select("hash", "owner", "repository")).where(shared)
    return each.join(copied.select("hash", F.lit(True).alias("example")), "hash", "left").withColumn(
        "example", F.coalesce("example", F.lit(False))
    )


def reported() -> F.Column:
    """What ``find_secrets`` names: base candidates always; of the others those that aren't examples."""
    return (F.col("kind") < len(BASE_KINDS)) | ~F.col("example")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_examples, n_live for every row of ``docs``.

    ``docs``: doc_id, text, source. Null or empty texts have no spans; repeated rows each have a row; null sources own
    nothing; an empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        rows = materialize(scanned(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("place")), ("doc_id", "source")))
    names = F.array(*map(F.lit, KINDS))
    span = F.struct("start", "kind", F.concat_ws(":", F.get(names, F.col("kind")), "start", "end").alias("said"))
    spans = (
        classified(rows, "source", "doc_id")
        .groupBy("place")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(reported(), span))), lambda s: s["said"]), ",").alias("spans"),
            F.sum(F.col("example").cast("long")).alias("n_examples"),
            F.sum((~F.col("example")).cast("long")).alias("n_live"),
        )
    )
    zero = F.lit(0).cast("long")
    return rows.join(spans, "place", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_examples", zero).alias("n_examples"),
        F.coalesce("n_live", zero).alias("n_live"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the value of each secret that is no example replaced by ``[kind]``, and n_chars brought up to date.

    Examples stay, whatever their kind. ``docs``: doc_id, source, text and any others, of any names; null sources own nothing.
    Texts without such a secret stay as they are, nulls included; repeated rows are each cut; an empty table stays empty. Rows are
    written once, with their candidates: only those that have any meet their cuts in an exchange.
    """
    placed = docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("place"))
    with small_batches(docs.sparkSession):
        rows = materialize(scanned(placed.select("_row", "_row.doc_id", "_row.source", "_row.text", "place"), ("doc_id", "source", "_row")))
    cuts = (
        classified(rows, "source", "doc_id")
        .where(~F.col("example"))
        .groupBy("place")
        .agg(F.array_sort(F.collect_list(F.struct("at", "end", "kind"))).alias("cuts"))
    )
    some = rows.where(F.size("found") > 0).select("_row", "place").join(cuts, "place", "left").select("_row", "cuts")
    whole = some.unionByName(rows.where(F.size("found") == 0).select("_row", F.lit(None).cast(some.schema["cuts"].dataType).alias("cuts")))
    names = F.array(*map(F.lit, KINDS))
    text = F.col("_row.text")

    def cut(state, c):
        # Candidates of several kinds may overlap: what is already covered isn't covered again.
        keep = F.when(c["at"] > state["to"], F.substring(text, state["to"] + 1, c["at"] - state["to"])).otherwise(F.lit(""))
        label = F.when(c["end"] > state["to"], F.concat(keep, F.lit("["), F.get(names, c["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], label).alias("out"), F.greatest(state["to"], c["end"]).alias("to"))

    clean = F.aggregate(
        "cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("to")),
        cut,
        lambda s: F.concat(s["out"], F.substring(text, s["to"] + 1, F.char_length(text))),
    )
    new = F.when(F.col("cuts").isNull(), text).otherwise(clean)
    columns = {"text": new} | ({"n_chars": F.when(F.col("cuts").isNull(), F.col("_row.n_chars")).otherwise(F.char_length(new).cast("long"))} if "n_chars" in docs.columns else {})
    return whole.select(*(columns.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
