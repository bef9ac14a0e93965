"""Semantic findings of programs from their text."""

from tensorjobs.operators import lint
from tensorjobs.operators.programs import program_checks


def found(spark, text, type_="", flow=False):
    df = spark.createDataFrame([("k", text, type_)], "key string, text string, type string")
    return sorted((r["kind"], r["line"], r["detail"]) for r in program_checks(df, type_="type", flow=flow).collect())


OUT = "↑ β @out"


def test_exempt_branch(spark):
    """A comparison of the loaded register with a jump to the last five instructions, or beyond; other registers and short jumps don't count."""
    head, tail = "↓ ε @is_exempt\n", "\n".join(["∎ δ #1"] * 8) + "\n" + OUT
    missing = [("exempt_handling", 0, None)]
    assert found(spark, head + "⋈ φ ε #0 #0.5\n\n↘ #6\n" + tail) == []
    assert found(spark, head + "⋈ φ ε #0 #0.5\n↘ #5\n" + tail) == []
    assert found(spark, head + "⋈ φ ε #0 #0.5\n↘ #4\n" + tail) == missing
    assert found(spark, head + "⋈ φ ε #0 #0.5\n∎ δ #1\n↘ #9\n" + tail) == missing
    assert found(spark, head + "⋈ φ ζ #0 #0.5\n↘ #9\n" + "∎ δ ε\n" + tail) == missing
    assert found(spark, head + "⋈ φ ε #0\n↘ #9\n" + tail) == missing
    assert found(spark, head + "⋈ φ ε #0 #0.5\n↘ #[9]\n" + tail) == missing
    assert found(spark, "↓ ε @other\n∎ δ ε\n" + tail) == []


def test_type_combinations(spark):
    """The suspicious pairs and unknown ones, in any word for the operation; numbers and registers without type say nothing."""
    types = "↓ ι:currency @a\n↓ κ:currency @b\n↓ ρ:ratio @r\n↓ γ:category @c\n↓ ν:count @n\n"
    uses = "∎ α ι κ ρ γ ν\n"
    bad = lambda text: [(line, detail) for kind, line, detail in found(spark, types + uses + text + OUT) if kind == "type_compatibility"]
    assert bad("∗ α ι κ\nMUL α ι ρ\n× α ρ ι\n") == [(7, "suspicious currency mul currency")]
    assert bad("+ α γ ι\n⊕ α ι γ\nSUB α ι κ\n") == [(7, "suspicious category add currency"), (8, "suspicious currency add category")]
    assert bad("∗ α γ ρ\n− α ρ ρ\n÷ α γ ρ\n") == [(7, "unknown category mul ratio"), (8, "unknown ratio add ratio")]
    assert bad("∗ α ι #2\n∗ α ι ω\n∗ α ι\n∗ α @x ι\n") == []
    # the last annotation of a register holds for the whole program
    assert bad("∗ α ι κ\n∎ κ:ratio #1\n") == []


def test_types_in_order(spark):
    """With `flow` an annotation holds from its place on, results and copies have types, other writes clear them."""
    types = "↓ ι:currency @a\n↓ ρ:ratio @r\n"
    bad = lambda text: [(line, detail) for kind, line, detail in found(spark, types + text + OUT, flow=True) if kind == "type_compatibility"]
    assert bad("∗ α ι ρ\n∗ β α ι\n") == [(4, "suspicious currency mul currency")]
    assert bad("∗ α ι #0.5\nMOV κ α\n∗ β κ ι\n") == [(5, "suspicious currency mul currency")]
    assert bad("∗ α ι ρ\n÷ α α ρ\n∗ β α ι\n") == []
    assert bad("∗ β ι ι\n∎ ι:ratio #1\n∗ γ ι ι\n") == [(3, "suspicious currency mul currency"), (5, "unknown ratio mul ratio")]


def test_inputs_outputs_rates_statuses(spark):
    assert found(spark, "↓ ι @a\n↓ κ @b\n◼") == [("missing_output", 0, None), ("unused_input", 1, "@a"), ("unused_input", 2, "@b")]
    assert found(spark, "↓ ι @a\n↓ ι @b\n∎ α κ\n" + OUT) == [("unused_input", 2, "@b")]
    assert found(spark, "META ι\n↓ ι @a\n↑ ι @a") == [("unused_input", 2, "@a")]
    assert found(spark, "∗ α ι #1.5\n∗ α ι #-0.1\n∗ α ι #1\n∗ α ι #[2]\n∗ α #7\n" + OUT) == [("rate_bounds", 1, "1.5"), ("rate_bounds", 2, "-0.1")]
    gates = "⋈ φ κ #0 #1.5\n↘ #5\n⋈ φ κ #0 #2.5\n↘ #4\n" + OUT
    assert found(spark, gates, "fit") == [("status_coverage", 0, "mfj")] and found(spark, gates, "SALES") == []
    assert found(spark, OUT, "SIT") == [("status_coverage", 0, "mfj"), ("status_coverage", 0, "single")]
    assert found(spark, None) == found(spark, " \n\t\n") == [("missing_output", 0, None)]


def test_code_and_data_of_answers(spark):
    """Fenced blocks, data in a later block or between code lines, open fences, answers without fences."""
    answers = {
        "two": ("Here:\n```nml\nLD R0 @x\nHALT\n```\nand\n```\n@x shape=1 data=5\n```\nbye", "LD R0 @x\nHALT", "@x shape=1 data=5"),
        "mixed": ("```\nLD R0 @x\n@x shape=1 data=5\nHALT\n```", "LD R0 @x\nHALT", "@x shape=1 data=5"),
        "open": ("text\n```\nLD R0 @x\nHALT", "LD R0 @x\nHALT", ""),
        "later text": ("```\nHALT\n```\n```\nno data here\n```", "HALT", ""),
        "bare": ("The program:\nLD R0 @x\nHALT\nhalts then", "LD R0 @x\nHALT", ""),
        "none": (None, "", ""),
    }
    df = spark.createDataFrame([(k, a) for k, (a, _, _) in answers.items()], "key string, response string")
    got = {r["key"]: (r["code"], r["data"]) for r in lint.extract_code_and_data(df).collect()}
    assert got == {k: (code, data) for k, (_, code, data) in answers.items()}
