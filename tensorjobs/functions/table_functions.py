"""Table functions that SQL can call."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators.audit import BRANCH_JUMP, STATUSES

STRUCTURE = "key string, kind string, status string, idx int, threshold double, rate double, cumulative double, amount double, line int"
_LINES = re.compile(r"\r\n|\r|\n")
_SPACE = " \t\n\v\f\r"


def _number(word: str | None) -> float | None:
    """The value of #123.45; None for anything else."""
    if not word or not re.match(r"#[^\[]", word):
        return None
    try:
        return float(word[1:])
    except ValueError:
        return None


class _Program:
    """A symbolic program as a list of (line, op, arguments)."""

    def __init__(self, text: str | None) -> None:
        words = [(i + 1, re.split(rf"[{_SPACE}]+", s.strip(_SPACE))) for i, s in enumerate(_LINES.split(text or ""))]
        self.code = [(i, w[0], w[1:]) for i, w in words if w != [""]]
        self.gates = {i: (STATUSES.get(v, "unknown"), int(jump)) for i in range(len(self.code) - 1) if (v := self._status(i)) is not None and (jump := self._jump(i + 1)) is not None}

    def arg(self, i: int, k: int) -> str | None:
        args = self.code[i][2] if i < len(self.code) else []
        return args[k] if k < len(args) else None

    def is_(self, i: int, op: str, *args: str) -> bool:
        return i < len(self.code) and self.code[i][1] == op and all(self.arg(i, k) == a for k, a in enumerate(args))

    def _status(self, i: int) -> float | None:
        return _number(self.arg(i, 3)) if self.is_(i, "⋈", "φ", "κ") else None

    def _jump(self, i: int) -> float | None:
        return _number(self.arg(i, 0)) if self.is_(i, "↘") else None

    def branches(self) -> Iterator[tuple[str, int, int]]:
        """(status, first instruction, first one after it)."""
        far = [i for i, (_, jump) in self.gates.items() if jump >= BRANCH_JUMP]
        if not far:
            yield "unknown", 0, len(self.code)
            return
        rest = far[-1] + 2 + self.gates[far[-1]][1]
        for i, end in zip(far, [*far[1:], rest], strict=True):
            yield self.gates[i][0], i + 2, min(end, len(self.code))
        stop = next((i for i in range(rest, len(self.code)) if self.code[i][1] in ("↑", "◼")), len(self.code))
        yield "hoh" if "mfj" in (self.gates[i][0] for i in far) else "default", rest, stop

    def rates(self, lo: int, hi: int) -> list[tuple]:
        """(kind, threshold, rate, cumulative, line) of a branch: its brackets by threshold, else its flat rate."""
        times = lambda i, *args: _number(self.arg(i, 2)) if i < hi and self.is_(i, "∗", *args) else None
        first = [("bracket", 0.0, times(i, "α", "π"), 0.0, self.code[i][0]) for i in range(lo, hi) if times(i, "α", "π") is not None][:1]
        higher = []
        for i in range(lo, hi - 1):
            amount, threshold = _number(self.arg(i, 1)), _number(self.arg(i + 1, 1))
            if self.is_(i, "∎", "α") and self.is_(i + 1, "∎", "γ") and amount is not None and threshold is not None:
                rate = next((r for k in (2, 3, 4) if (r := times(i + k)) is not None), 0.0)
                higher.append(("bracket", threshold, rate, amount, self.code[i][0]))
        if first or higher:
            return sorted(first + higher, key=lambda b: b[1])
        return [("flat", None, times(i, "γ", "ι"), None, self.code[i][0]) for i in range(lo, hi) if times(i, "γ", "ι") is not None][:1]

    def deductions(self) -> dict[str, tuple[float, int]]:
        """The first positive amount of each status between the first short gate and the branches."""
        short = next((i for i, (_, jump) in self.gates.items() if jump < BRANCH_JUMP), None)
        if short is None:
            return {}
        end = next((i for i, (_, jump) in self.gates.items() if jump >= BRANCH_JUMP), min(short + 30, len(self.code)))
        status, out = "default", {}
        for i in range(short, end):
            line, op, _ = self.code[i]
            value = _number(self.arg(i, 3 if op == "⋈" else 1))
            if op == "⋈" and self.arg(i, 1) == "κ" and value is not None:
                status = STATUSES.get(value, "unknown")
            elif op == "→":
                status = "default"
            elif self.is_(i, "∎", "γ") and value is not None and value > 0:
                out.setdefault(status, (value, line))
        return out


class ExtractRateStructure:
    """The rows of `audit.extract_rate_structure` for a table of programs (key, text); other columns are ignored."""

    def eval(self, row: Row) -> Iterator[tuple]:
        program = _Program(row["text"])
        for status, lo, hi in program.branches():
            for idx, (kind, threshold, rate, cumulative, line) in enumerate(program.rates(lo, hi)):
                yield row["key"], kind, status, idx, threshold, rate, cumulative, None, line
        for status, (amount, line) in program.deductions().items():
            yield row["key"], "deduction", status, 0, None, None, None, amount, line


def register(spark: SparkSession) -> None:
    """Make them known to SQL: SELECT * FROM extract_rate_structure(TABLE(programs) PARTITION BY key)."""
    spark.udtf.register("extract_rate_structure", udtf(ExtractRateStructure, returnType=STRUCTURE))
