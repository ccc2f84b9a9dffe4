"""Chat formatting by schema fingerprints, built from DataFrame functions alone.

Records arrive in different layouts: prompt and response columns, instruction/input/output, or lists of
messages under several names. Of the nested field paths (of any depth) that some mapping uses, those that a record really fills
are sorted and hashed; the hash picks a declarative mapping that turns the record into canonical turns (role, text). A template then writes the turns
with control strings between them, and escapes control strings inside texts so that they can be read back.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. A control string inside a text gets a backslash after its first
character (``<|im_end|>`` becomes ``<\\|im_end|>``; one that already has backslashes there gets one more), so no
text holds a control string and removing one backslash restores it. In roles ``&`` and line ends become entities.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text) with null turns first, ties
and repeated rows stay as separate turns; a record whose paths match no mapping gets layout null and null turns (never
dropped); an empty table gives no rows; other columns, and fields of items or structures that no mapping uses, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
# fixed values: control strings of common chat templates, none of which may appear raw inside a text
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

_REST = "|".join("".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in s[1:]) for s in sorted(CONTROL, key=len, reverse=True))
_RAW = rf"(<|\[)(\\*)({_REST})"
_ESCAPED = rf"(<|\[)\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_RAW), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit(r"$1$2$3"))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("&#10;"))


def _role_back(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&")))


@dataclass(frozen=True)
class Mapping:
    """``fields`` gives (role, path) pairs in order; or ``items`` is the path of a list with a role and a text field. Paths into structures have dots."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> frozenset[str]:
        """All paths that this mapping uses."""
        return frozenset().union(*self.path_sets())

    def path_sets(self) -> list[frozenset[str]]:
        """Every set of filled paths that this mapping takes."""
        if self.items:
            inner = [f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"]
            return [frozenset({self.items, *some}) for k in range(3) for some in combinations(inner, k)]
        must = frozenset(p for _, p in self.fields) - self.optional
        extra = sorted(self.optional)
        return [must | frozenset(c) for k in range(len(extra) + 1) for c in combinations(extra, k)]


SHAREGPT = {"human": "user", "gpt": "assistant"}
MAPPINGS = (
    Mapping("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=frozenset({"input"})),
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("conversations", items="conversations", role="from", text="value", roles=SHAREGPT),
)


def _walk(kind: T.DataType, path: str) -> Iterator[tuple[str, Callable[[Column], Column]]]:
    """(path, test whether a value fills it) of a field and all fields below it; fields of list items as ``name[].field``."""
    yield path, lambda c: c.isNotNull()
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            for p, test in _walk(f.dataType, f"{path}.{f.name}"):
                yield p, lambda c, test=test, name=f.name: test(c.getField(name))
    elif isinstance(kind, T.ArrayType):
        for p, test in _walk(kind.elementType, f"{path}[]"):
            yield p, lambda c, test=test: F.exists(c, lambda item: test(item))


def _tests(schema: T.StructType, used: frozenset[str]) -> dict[str, Column]:
    """Tests of the paths in ``used`` that the schema has."""
    return {p: test(F.col(f"`{f.name}`")) for f in schema.fields for p, test in _walk(f.dataType, f.name) if p in used}


def fingerprint(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Hash of the nested paths that a record fills, of those that a mapping uses."""
    tests = _tests(schema, frozenset().union(*[m.paths() for m in mappings]))
    filled = F.array_compact(F.array(*[F.when(test, F.lit(p)) for p, test in tests.items()], F.lit(None).cast("string")))
    return F.sha2(F.array_join(F.array_sort(filled), "\n"), 256)


def _below(item: Column, path: str) -> Column:
    for name in path.split("."):
        item = item.getField(name)
    return item


def _known(mapping: Mapping) -> list[Column]:
    return [F.sha2(F.lit("\n".join(sorted(paths))), 256) for paths in mapping.path_sets()]


def _turns(mapping: Mapping, present: set[str]) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if mapping.items:
        renamed = lambda r: F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.roles.items() for x in kv])[r], r) if mapping.roles else r
        return F.transform(mapping.items, lambda m: F.struct(text(renamed(_below(m, mapping.role))).alias("role"), text(_below(m, mapping.text)).alias("text")))
    each = [F.when(F.col(p).isNotNull(), F.struct(F.lit(r).alias("role"), text(F.col(p)).alias("text"))) for r, p in mapping.fields if p in present]
    return F.array_compact(F.array(*each))


def canonical_turns(records: DataFrame, key: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``key`` columns, ``fingerprint``, ``layout`` and ``turns`` of every record; unfilled fields have to be null."""
    schema = T.StructType([f for f in records.schema.fields if f.name not in key])
    present = set(_tests(schema, frozenset().union(*[m.paths() for m in mappings])))
    usable = [m for m in mappings if m.paths() - m.optional <= present]
    out = records.withColumn("_fp", fingerprint(schema, mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in usable:
        hit = F.col("_fp").isin(*[k for k in _known(m)])
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, _turns(m, present)).otherwise(turns)
    return out.select(*key, F.col("_fp").alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))


def formatted(turns: DataFrame, key: list[str]) -> DataFrame:
    """``pieces``: the formatted text in order, each piece marked with its place in the loss mask; joined they are ``formatted``."""
    loss = lambda t: t["role"] == LOSS_ROLE
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), loss(t).alias("loss")),
                F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = turns.select(*key, pieces.alias("pieces"))
    return out.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))


def read_back(made: DataFrame, key: list[str]) -> DataFrame:
    """Turns parsed from the formatted text, and the unescaped text under the loss mask."""
    parts = F.split("formatted", F.lit(r"<\|im_start\|>"))
    blocks = F.slice(parts, F.lit(2), F.size(parts))
    one = lambda b: F.struct(
        _role_back(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.split(F.regexp_replace(b, F.lit(r"^[^\n]*\n"), F.lit("")), F.lit(r"<\|im_end\|>"))[0]).alias("text"),
    )
    under = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"]))
    return made.select(*key, "formatted", F.transform(blocks, one).alias("turns"), F.array_join(under, "").alias("loss_text"))


def recorded(rows: DataFrame) -> DataFrame:
    """Rows by turn as records, each in the plainest layout that holds it without loss."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), text("role").alias("role"), text("text").alias("content")))).alias("t"))
    is_ = lambda *roles: F.transform("t", lambda x: x["role"]) == F.array(*[F.lit(r) for r in roles])
    pair, triple = is_("user", "assistant"), is_("system", "user", "assistant")
    return grouped.select(
        "conv_id",
        F.when(triple, F.col("t")[0]["content"]).alias("system"),
        F.when(pair, F.col("t")[0]["content"]).when(triple, F.col("t")[1]["content"]).alias("prompt"),
        F.when(pair, F.col("t")[1]["content"]).when(triple, F.col("t")[2]["content"]).alias("response"),
        F.when(~pair & ~triple, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE).alias("text"))
    turns = canonical_turns(recorded(rows.unionByName(probe)), ["conv_id"])
    back = read_back(formatted(turns, ["conv_id"]), ["conv_id"])
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, regexp_replace(text, '(<|\\[)(\\\\*)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|<SYS>>|</SYS>>|/INST\\]|INST\\]|/s>|s>)', '\\1\\\\\\2\\3', 'g') AS out FROM rows)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(out) + 12 + 1 + 10 + 1)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id"""
