"""Checks that a sample must pass, as expressions that give the first reason against it, or null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.scoring import first_reason

#: What the checks look for, which results depend on.
PLACEHOLDERS = ("placeholder", "lorem ipsum", "todo", "tbd", "dummy", "your question here")
TRIVIAL = ("capital of", "define ", "explain ", "summarize ", "write a poem", "tell me a joke")
ASKING = ("what is", "who is", "when is", "where is")
GENERIC_NAMES = ("tool", "function", "api", "call")
PRIMITIVES = ("string", "number", "integer", "float", "boolean", "int", "bool", "str")
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2CEAF}]"


def holds_any(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def is_placeholder(text: Column, words: Sequence[str] = PLACEHOLDERS, least: int = 8) -> Column:
    """Null, shorter than ``least`` characters, or with a placeholder's word."""
    return text.isNull() | (F.length(F.trim(text)) < least) | F.lower(text).rlike(r"\b(" + "|".join(words) + r")\b")


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def trivial(question: Column, n_calls: Column, n_args: Column) -> Column:
    """Why a question is too easy; ``n_args`` are those of the first call."""
    q = F.lower(F.trim(question))
    return first_reason(
        (F.length(q) < 25, "question_too_short"), (holds_any(q, TRIVIAL), "likely_no_tool_needed"), ((n_calls == 1) & (n_args <= 1) & holds_any(q, ASKING), "too_trivial_single_call")
    )


def leaks(question: Column, tokens: Sequence[str]) -> Column:
    """The first of ``tokens``, or ``$var$``, that a question gives away."""
    q = F.lower(question)
    return first_reason(*[(F.contains(q, F.lit(t)), t) for t in tokens], (question.rlike(r"\$var_?[0-9]*[^$ ]*\$"), "$var$"))


def reads_like_thought(text: Column, most: int = 60) -> Column:
    """More words than a rationale has."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) > most, F.lit(False))


def tool_schema_reason(tools: Column) -> Column:
    """Why a tool list is bad: of its first bad tool, the first of name, repeated name, description, parameters, types.

    A tool is a struct (name, description, types), types being those of its parameters.
    """

    def reason(t: Column, i: Column) -> Column:
        name = t["name"]
        bad = F.coalesce((name == "") | name.rlike("^[A-Za-z]{1,2}$") | F.lower(name).isin(*GENERIC_NAMES), F.lit(True))
        before = F.transform(F.slice(tools, 1, i), lambda x: x["name"])
        return first_reason(
            (bad, "bad_tool_name"), (F.array_contains(before, name), "duplicate_tool_name"), (F.coalesce(F.length(F.trim(t["description"])) < 5, F.lit(True)), "short_description"),
            (F.coalesce(F.size(t["types"]) == 0, F.lit(True)), "missing_parameters"), (F.exists(t["types"], lambda x: ~x.isin(*PRIMITIVES)), "nonprimitive_type"),
        )

    found = F.filter(F.transform(tools, reason), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(tools), F.lit(0)) <= 0, "no_tools").otherwise(F.get(found, F.lit(0)))


def call_schema_reason(calls: Column, known: Column, required: Column) -> Column:
    """Why a call list is bad: of its first bad call, an unknown tool or a required argument that it lacks."""
    keys = lambda c: F.transform(c["args"], lambda e: e["k"])
    reason = lambda c: first_reason((~F.array_contains(known, c["name"]), "unknown_tool"), (F.size(F.array_except(required, keys(c))) > 0, "missing_required_arg"))
    found = F.filter(F.transform(calls, reason), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(calls), F.lit(0)) <= 0, "no_calls").otherwise(F.get(found, F.lit(0)))


#: A comma that sets thousands apart, with digits of the same number before it and three more behind.
_THOUSANDS = r"(?<=(?<![0-9,])[0-9]{1,3}(?:,[0-9]{3}){0,6}),(?=[0-9]{3}(?:,[0-9]{3})*(?![0-9]))"


def _words(text: Column) -> Column:
    """Lower-case words of a-z and digits with blanks around each; whatever else stands there is between words, but for commas inside a number of thousands, which is one word."""
    whole = F.when(F.contains(text, F.lit(",")), F.regexp_replace(text, _THOUSANDS, "")).otherwise(text)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(whole), "[^a-z0-9]+", " ")), F.lit(" "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_NUMBER_OF = {w: str(i) for i, w in enumerate(UNITS)} | {w: str(10 * i) for i, w in enumerate(TENS, 2)}
_WORD_OF = {n: w for w, n in _NUMBER_OF.items()}


def grounding_variants(value: Column) -> Column:
    """How a value may stand in a question, as words with blanks around: as it is, as a whole number, as a number word or as the number that a word names."""
    table = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def variants(words: Column, whole: Column) -> Column:
        padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        digits = F.ltrim(whole, F.lit("-"))
        return F.array(words, padded(digits), padded(F.element_at(table(_WORD_OF), whole)), padded(F.element_at(table(_NUMBER_OF), F.trim(words))))

    number = value.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("long").cast("string"))
    found = _let(F.struct(_words(value).alias("words"), whole.alias("whole")), lambda v: variants(v["words"], v["whole"]))
    return F.filter(found, lambda x: F.trim(x) != "")


def grounded_share(question: Column, values: Column) -> Column:
    """Share of values that a question names as whole words; null values, booleans and references do not count, and 1 if none is left.

    Question and values are compared as words of a-z and digits in lower case, so signs, points and other scripts do not tell two apart, nor do
    commas that set thousands apart; a value without such a word is never named.
    """
    counted = F.filter(values, lambda v: v.isNotNull() & ~F.lower(v).isin("true", "false") & ~v.rlike(r"^\$.*\$$"))

    def share(asked: Column, kept: Column) -> Column:
        hit = F.filter(kept, lambda v: F.exists(grounding_variants(v), lambda x: F.contains(asked, x)))
        return F.when(F.size(kept) == 0, 1.0).otherwise(F.size(hit) / F.size(kept))

    return _let(F.struct(F.coalesce(_words(question), F.lit(" ")).alias("asked"), counted.alias("kept")), lambda s: share(s["asked"], s["kept"]))


def context_reason(input_chars: Column, n_tools: Column, prompt_tokens: Column, completion_tokens: Column, most_chars: int, most_tools: int, most_prompt: int, most_completion: int) -> Column:
    return first_reason(
        (input_chars > most_chars, "input_too_long"), (n_tools > most_tools, "tool_menu_too_large"), (prompt_tokens > most_prompt, "prompt_tokens_over_budget"),
        (completion_tokens > most_completion, "completion_tokens_over_budget"),
    )


def solver_gap(weak: Column, strong: Column, weak_max: float, gap_min: float, strong_min: float) -> Column:
    """Why a task does not tell a weak solver from a strong one; a null ``strong`` was not run, as the weak one passed."""
    return first_reason(
        (strong.isNull(), "weak_solver_passed"), ((weak > weak_max) & (strong >= strong_min), "too_easy_both_solvers_pass"), (weak > weak_max, "weak_solver_passed"),
        ((strong < strong_min) & (strong < 0.5), "too_hard_both_solvers_fail"), (strong < strong_min, "strong_solver_failed"), (strong - weak < gap_min, "weak_strong_gap_too_small"),
    )


def borderline(positive: Column, spread: Column, success: Column, parse_rate: Column, unique: Column, n_classes: Column, least_spread: float = 0.05, most_parse: float = 0.5) -> Column:
    """Whether a group's signal is near enough to a limit to be probed again."""
    near = ((spread >= 0.01) & (spread < least_spread) & (success == 0)) | ((unique == 2) & (spread < least_spread) & (n_classes <= 1))
    return positive & (near | ((parse_rate >= 0.20) & (success == 0)) | (F.abs(parse_rate - most_parse) < 0.001))


def sample_quality(question: Column, n_calls: Column, n_tools: Column) -> Column:
    """Length, calls and tools up to a point each, less one for a dummy."""
    score = F.least(F.lit(1.0), F.length(question) / 220) + F.least(F.lit(1.0), n_calls / 3) + F.least(F.lit(1.0), n_tools / 4)
    return F.greatest(F.lit(0.0), score - F.lower(question).rlike(r"\b(dummy|placeholder|lorem ipsum)\b").cast("double"))


def judge_score(text: Column) -> Column:
    """A judge's score of 1 to 5: the first of these digits, wherever it stands, else the smallest number that is spelled in the answer, inside words, too; null if there is neither."""
    spelled = F.lit(None).cast("int")
    for score in range(5, 0, -1):
        spelled = F.when(F.contains(F.lower(text), F.lit(UNITS[score])), score).otherwise(spelled)
    return F.coalesce(F.nullif(F.regexp_extract(text, "[1-5]", 0), F.lit("")).cast("int"), spelled)
