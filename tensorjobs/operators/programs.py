"""Checks of symbolic programs from their text: inputs, outputs, statuses, rates, exempt branches, operand types.

A program is one row; its lines become an array of instructions that expressions fold over, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import BRANCH_JUMP, key_type

#: Words without computation, multiplications, additions, types that need status branches and those branches, and
#: the operand types whose combination is fine or suspicious. Every other combination of two known types is unknown.
META = ["META", "§", "METADATA", "FRAG", "◆", "FRAGMENT", "ENDF", "◇", "END_FRAGMENT"]
MULTIPLY = ["∗", "MUL", "×"]
ADD = ["+", "ADD", "⊕", "−", "SUB", "⊖"]
BRANCHED_TYPES = ["FIT", "SIT", "COUNTY"]
BRANCHES = {"single": 1.5, "mfj": 2.5}
FINE = [("currency", "ratio", "mul"), ("ratio", "currency", "mul"), ("currency", "currency", "add")]
SUSPICIOUS = [("currency", "currency", "mul"), ("category", "currency", "add"), ("currency", "category", "add")]
#: Instructions before the end where a branch for the exempt may lead.
EXEMPT_TAIL = 5
#: What multiplications and additions give, by their operand types; others give no type.
GIVES = {("currency", "ratio", "mul"): "currency", ("ratio", "currency", "mul"): "currency", ("currency", "currency", "add"): "currency", ("ratio", "ratio", "add"): "ratio", ("count", "count", "add"): "count", ("count", "count", "mul"): "count"}

_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def instructions(text: Column) -> Column:
    """The instructions of a text: array of (line from 1, op, args, types). `register:type` is a register with a type; null texts have none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), _LINES), lambda s, i: F.struct((i + 1).alias("line"), F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "").alias("w")))
    return F.transform(F.filter(lines, lambda x: F.size(x["w"]) > 0), _instruction)


def _instruction(x: Column) -> Column:
    op = F.get(x["w"], F.lit(0))
    typed = lambda a: a.contains(":") & ~a.rlike("^[#@]") & ~op.isin(META)
    args = F.slice(x["w"], F.lit(2), F.size(x["w"]))
    return F.struct(
        x["line"].alias("line"), op.alias("op"),
        F.transform(args, lambda a: F.when(typed(a), F.regexp_extract(a, r"(?s)^(.*):", 1)).otherwise(a)).alias("args"),
        F.transform(args, lambda a: F.when(typed(a), F.substring_index(a, ":", -1))).alias("types"),
    )


def _arg(x: Column, i: int) -> Column:
    return F.get(x["args"], F.lit(i))


def _number(a: Column) -> Column:
    """The value of #123.45; null for anything else."""
    return F.when(a.rlike(r"^#[^\[]"), F.substring(a, 2, 1000).try_cast("double"))


def _finding(kind: str, severity: str, line: Column, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), line.cast("int").alias("line"), detail.cast("string").alias("detail"))


def _combined(op: Column) -> Column:
    return F.when(op.isin(MULTIPLY), "mul").when(op.isin(ADD), "add")


def _verdict(left: Column, right: Column, kind: Column) -> Column:
    """`suspicious` or `unknown` for operand types that don't go together; null if they do or one isn't known."""
    is_in = lambda table: F.struct(left, right, kind).isin([F.struct(*map(F.lit, t)) for t in table])
    known = left.isNotNull() & right.isNotNull() & kind.isNotNull()
    return F.when(known & ~is_in(FINE), F.when(is_in(SUSPICIOUS), "suspicious").otherwise("unknown"))


def _typed_findings(code: Column, annotated: Column) -> Column:
    """Types as annotated anywhere in the program, the last annotation of a register for all its uses."""
    of = lambda a: F.try_element_at(F.filter(annotated, lambda t: t["reg"] == a), F.lit(-1))["type"]
    named = lambda a: ~F.coalesce(a.rlike("^[#@]"), F.lit(True))
    some = F.filter(code, lambda x: _combined(x["op"]).isNotNull() & (F.size(x["args"]) >= 3) & named(_arg(x, 1)) & named(_arg(x, 2)))
    found = F.transform(some, lambda x: F.struct(x["line"].alias("line"), of(_arg(x, 1)).alias("a"), of(_arg(x, 2)).alias("b"), _combined(x["op"]).alias("kind")))
    return _as_findings(found)


def _as_findings(found: Column) -> Column:
    """Findings of an array of (line, a, b, kind)."""
    bad = F.filter(found, lambda x: _verdict(x["a"], x["b"], x["kind"]).isNotNull())
    return F.transform(bad, lambda x: _finding("type_compatibility", "warning", x["line"], F.concat_ws(" ", _verdict(x["a"], x["b"], x["kind"]), x["a"], x["kind"], x["b"])))


def _flow_findings(code: Column) -> Column:
    """Types in the order of instructions: an annotation types its register from there on, results of arithmetic are typed by GIVES (a
    number counts as ratio), a copy takes the type of what it copies, and any other instruction clears what it writes."""
    gives = F.create_map(*[F.lit(x) for (a, b, k), t in GIVES.items() for x in (f"{a} {b} {k}", t)])
    find = lambda types, a: F.try_element_at(F.filter(types, lambda t: t["reg"] == a), F.lit(-1))["type"]
    entry = lambda reg, type_: F.struct(reg.alias("reg"), type_.alias("type"))
    empty = "cast(array() as array<struct<line:int,a:string,b:string,kind:string>>)"

    def step(state: Column, x: Column) -> Column:
        given = F.filter(F.transform(x["args"], lambda a, i: entry(a, F.get(x["types"], i))), lambda t: t["type"].isNotNull())
        types = F.concat(F.filter(state["types"], lambda t: ~F.exists(given, lambda g: g["reg"] == t["reg"])), given)
        kind = _combined(x["op"])
        of = lambda i: F.coalesce(find(types, _arg(x, i)), F.when(_number(_arg(x, i)).isNotNull(), "ratio"))
        both = kind.isNotNull() & (F.size(x["args"]) >= 3)
        result = F.when(both, F.try_element_at(gives, F.concat_ws(" ", of(1), of(2), kind))).when(x["op"].isin("⇐", "MOV"), of(1))
        own = F.get(x["types"], F.lit(0)).isNotNull()
        writes = (F.size(x["args"]) >= 2) & ~x["op"].isin([*META, "↑", "ST", "⋈", "CMPI"]) & ~own
        after = F.when(writes, F.concat(F.filter(types, lambda t: t["reg"] != _arg(x, 0)), F.array(entry(_arg(x, 0), result)))).otherwise(types)
        registers = both & ~_arg(x, 1).rlike("^[#@]") & ~_arg(x, 2).rlike("^[#@]")
        seen = F.when(registers, F.array(F.struct(x["line"].alias("line"), of(1).alias("a"), of(2).alias("b"), kind.alias("kind")))).otherwise(F.expr(empty))
        return F.struct(F.filter(after, lambda t: t["type"].isNotNull()).alias("types"), F.concat(state["found"], seen).alias("found"))

    start = F.struct(F.expr("cast(array() as array<struct<reg:string,type:string>>)").alias("types"), F.expr(empty).alias("found"))
    return _as_findings(F.aggregate(code, start, step, lambda s: s["found"]))


def program_checks(programs: DataFrame, key: str = "key", text: str = "text", type_: str | None = None, flow: bool = False) -> DataFrame:
    """(key, kind, severity, line, detail): findings of programs, one row each.

    - missing_output (error): no store.
    - unused_input: a load whose register no other instruction than loads and stores names; the register's last load counts.
    - rate_bounds: a multiplication by a number outside [0, 1].
    - status_coverage: a program of a branched type (`type_` column, else the key's) without a far branch for a status.
    - exempt_handling: `@is_exempt` is loaded, but no comparison of its register is followed by a jump that ends within EXEMPT_TAIL
      instructions of the program's end or beyond.
    - type_compatibility: two registers whose types don't go together. Types are those annotated anywhere in the program; with
      `flow` they are followed in order, through arithmetic and copies.
    """
    kind = F.upper(F.coalesce(F.col(type_), F.lit(""))) if type_ else key_type(F.col(key))
    rows = programs.select(F.col(key).alias("key"), kind.alias("_t"), instructions(F.col(text)).alias("_c"))
    code = F.col("_c")
    entry = lambda x: F.filter(F.transform(x["args"], lambda a, i: F.struct(a.alias("reg"), F.get(x["types"], i).alias("type"))), lambda t: t["type"].isNotNull())
    rows = rows.withColumn("_a", F.flatten(F.transform(code, entry)))
    next_ = lambda i: F.get(code, i + 1)
    jump = lambda i: F.when(next_(i)["op"] == "↘", _number(_arg(next_(i), 0)))
    compares = lambda x: (x["op"] == "⋈") & (F.size(x["args"]) >= 4)
    # inputs and outputs
    loads = F.filter(code, lambda x: (x["op"] == "↓") & (F.size(x["args"]) >= 2))
    plain = F.filter(code, lambda x: ~x["op"].isin([*META, "↑"]) & ~((x["op"] == "↓") & (F.size(x["args"]) >= 2)))
    rows = rows.withColumns({"_l": F.transform(loads, lambda x: F.struct(_arg(x, 0).alias("reg"), _arg(x, 1).alias("name"), x["line"].alias("line"))), "_u": F.array_distinct(F.flatten(F.transform(plain, lambda x: x["args"])))})
    last = F.filter("_l", lambda x, i: ~F.exists(F.slice("_l", i + 2, F.size("_l")), lambda y: y["reg"] == x["reg"]))
    unused = F.filter(last, lambda x: ~F.array_contains("_u", x["reg"]) | x["reg"].rlike("^[#@]"))
    silent = F.when(~F.exists(code, lambda x: x["op"] == "↑"), F.array(_finding("missing_output", "error", F.lit(0), F.lit(None))))
    # rates and statuses
    wrong = F.filter(code, lambda x: (x["op"] == "∗") & (F.size(x["args"]) >= 3) & ~F.coalesce(_number(_arg(x, 2)).between(0.0, 1.0), F.lit(True)))
    far = F.filter(code, lambda x, i: compares(x) & (_arg(x, 0) == "φ") & (_arg(x, 1) == "κ") & (F.coalesce(jump(i), F.lit(0.0)).cast("int") >= BRANCH_JUMP))
    branches = F.transform(far, lambda x: _number(_arg(x, 3)))
    lacking = F.filter(F.array(*[F.when(F.col("_t").isin(BRANCHED_TYPES) & ~F.coalesce(F.array_contains(branches, F.lit(v)), F.lit(False)), _finding("status_coverage", "warning", F.lit(0), F.lit(s))) for s, v in BRANCHES.items()]), lambda x: x.isNotNull())
    # the exempt
    exempt = _arg(F.get(F.filter(loads, lambda x: _arg(x, 1).contains("@is_exempt")), F.lit(0)), 0)
    lands = lambda i: (i + 1) + jump(i).cast("int") >= F.size(code) - EXEMPT_TAIL
    leaves = F.exists(F.transform(code, lambda x, i: F.coalesce(compares(x) & (_arg(x, 1) == F.col("_e")) & lands(i), F.lit(False))), lambda b: b)
    rows = rows.withColumn("_e", exempt)
    stuck = F.when(F.col("_e").isNotNull() & ~leaves, F.array(_finding("exempt_handling", "warning", F.lit(0), F.lit(None))))
    none = F.expr("cast(array() as array<struct<kind:string,severity:string,line:int,detail:string>>)")
    every = F.concat(
        F.coalesce(silent, none), F.transform(unused, lambda x: _finding("unused_input", "warning", x["line"], x["name"])),
        F.transform(wrong, lambda x: _finding("rate_bounds", "warning", x["line"], F.substring(_arg(x, 2), 2, 1000))), lacking, F.coalesce(stuck, none),
        _flow_findings(code) if flow else _typed_findings(code, F.col("_a")),
    )
    return rows.select("key", F.inline(every))
