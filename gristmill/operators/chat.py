"""Column builders over ``messages ARRAY<STRUCT<role, content>>`` (nulls inside are malformed turns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

TURN = "struct<role:string,content:string>"


def turn(role: Column | str, content: Column | str) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def _role(m: Column) -> Column:
    r = F.lower(T.strip(m["role"]))
    return F.when(r == "human", "user").when(r.isin("gpt", "bot"), "assistant").otherwise(r)


def strict(messages: Column) -> Column:
    """Canonical turns; one bad turn voids the row (null)."""
    good = F.forall(messages, lambda m: m.isNotNull() & _role(m).isin("system", "user", "assistant") & m["content"].isNotNull())
    fixed = F.transform(messages, lambda m: turn(_role(m), T.newlines(m["content"])))
    return F.when((F.size(messages) > 0) & F.coalesce(good, F.lit(False)), fixed)


def lenient(messages: Column) -> Column:
    """Canonical turns without the bad and empty ones."""
    kept = F.filter(messages, lambda m: F.coalesce(m.isNotNull() & _role(m).isin("system", "user", "assistant") & (T.strip(m["content"]) != ""), F.lit(False)))
    return F.coalesce(F.transform(kept, lambda m: turn(_role(m), T.newlines(m["content"]))), F.array().cast(f"array<{TURN}>"))


def last_index(messages: Column, role: str) -> Column:
    """The 1-based place of the last turn of a role, 0 where there is none."""
    marks = F.transform(messages, lambda m, i: F.when(m["role"] == role, i + 1).otherwise(0))
    return F.coalesce(F.array_max(marks), F.lit(0))


def last_content(messages: Column, role: str) -> Column:
    return F.try_element_at(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"]), F.lit(-1))


def answer_after_last_user(messages: Column) -> Column:
    """The assistant turn after the last user turn, else the last assistant turn."""
    after = F.filter(messages, lambda m, i: (i >= last_index(messages, "user")) & (m["role"] == "assistant"))
    return F.coalesce(F.try_element_at(F.transform(after, lambda m: m["content"]), F.lit(1)), last_content(messages, "assistant"))


def prompt_turns(messages: Column) -> Column:
    """Up to the last user turn."""
    return F.slice(messages, F.lit(1), last_index(messages, "user"))


def first_rounds(messages: Column, rounds: int) -> Column:
    """The system turn and at most so many rounds."""
    system = F.filter(messages, lambda m, i: (i == 0) & (m["role"] == "system"))
    rest = F.filter(messages, lambda m, i: (i > 0) | (m["role"] != "system"))
    return F.concat(system, F.slice(rest, 1, 2 * rounds))


def without_trailing_user(messages: Column) -> Column:
    last = F.coalesce(F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] != "user", i + 1).otherwise(0))), F.lit(0))
    return F.slice(messages, F.lit(1), last)


def with_system(messages: Column, default: str) -> Column:
    """A default system turn in front, unless there is one or nothing else."""
    missing = (F.size(messages) > 0) & (F.try_element_at(messages, F.lit(1))["role"] != "system")
    return F.when(missing, F.concat(F.array(turn("system", default)), messages)).otherwise(messages)


def render(messages: Column, joint: str = ": ") -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(joint), m["content"])), "\n\n")


def tail_key(messages: Column, chars: int = 3000) -> Column:
    """The hash of the end of the rendered, normalised exchange."""
    return T.sha1(F.right(T.hash_key(render(messages)), F.lit(chars)))


def pair_key(prompt: Column, chosen: Column) -> Column:
    return T.sha1(F.lower(T.collapse(F.concat(F.right(prompt, F.lit(2000)), F.lit("\x1f"), F.left(chosen, F.lit(2000))))))


def from_instruction(instruction: Column, context: Column, output: Column, system: str) -> Column:
    user = F.when(T.strip(F.coalesce(context, F.lit(""))) == "", T.strip(instruction)).otherwise(F.concat(T.strip(instruction), F.lit("\n\n"), T.strip(context)))
    return F.array(turn("system", system), turn("user", user), turn("assistant", T.newlines(output)))


def has_role(messages: Column, role: str) -> Column:
    return F.exists(messages, lambda m: m["role"] == role)


def user_text(messages: Column) -> Column:
    return F.lower(F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"]), "\n"))


def split_dialogue(text: Column) -> Column:
    """``Human:``/``Assistant:`` dialogue text as turns."""
    parts = F.filter(F.split(text, r"\n\n(?=(?:Human|Assistant): )"), lambda p: T.strip(p) != "")
    return F.transform(parts, lambda p: turn(F.when(T.strip(p).startswith("Human:"), "user").otherwise("assistant"), T.strip(T.sub(p, r"^\s*(?:Human|Assistant):\s*"))))


def preference_pair(chosen: Column, rejected: Column) -> Column:
    """``messages, chosen, rejected`` where both sides share all turns but the last, else null."""
    n = F.size(chosen)
    same = (n == F.size(rejected)) & (n >= 2) & (F.slice(chosen, F.lit(1), F.greatest(n - 1, F.lit(0))) == F.slice(rejected, F.lit(1), F.greatest(n - 1, F.lit(0))))
    last = lambda m: F.try_element_at(m, F.lit(-1))["content"]
    return F.when(same & (last(chosen) != last(rejected)), F.struct(F.slice(chosen, F.lit(1), n - 1).alias("messages"), last(chosen).alias("chosen"), last(rejected).alias("rejected")))


def example_weight(messages: Column, bucket: Column, weight: Column, patterns: list[str], down: float = 0.3) -> Column:
    """Lower weight for refusing answers outside safety data, times the row's own weight."""
    refusing = F.exists(messages, lambda m: (m["role"] == "assistant") & T.any_of(F.lower(m["content"]), patterns))
    base = F.when(refusing & ~F.coalesce(bucket.contains("safety"), F.lit(False)), F.lit(down)).otherwise(F.lit(1.0))
    return base * F.coalesce(weight, F.lit(1.0))


def group_id(keys: list[Column], text: Column) -> Column:
    """The first key that a row has, else a hash of its text."""
    return F.coalesce(*[F.nullif(F.trim(k), F.lit("")) for k in keys], F.concat(F.lit("hash_"), F.sha1(text)))


def acceptance(messages: Column, banned: list[str], min_chars: int, rounds: int) -> Column:
    """Why an exchange of canonical turns is not taken, or ``kept``: banned parts or few characters in an answer,
    or no user or assistant turn left in the first rounds without trailing user turns."""
    def answers(test) -> Column:  # noqa: ANN001
        return F.exists(messages, lambda m: (m["role"] == "assistant") & test(m["content"]))

    rest = without_trailing_user(first_rounds(messages, rounds))
    return (
        F.when(answers(lambda c: T.any_of(c, banned)), "banned")
        .when(answers(lambda c: F.length(T.strip(c)) < min_chars), "short_answer")
        .when(~has_role(rest, "user"), "no_user")
        .when(~has_role(rest, "assistant"), "no_assistant")
        .otherwise("kept")
    )


def pair_verdict(prompt: Column, chosen: Column, rejected: Column, min_chars: int, max_prompt: int) -> Column:
    """Why a preference pair is not taken, or ``kept``."""
    return (
        F.when((T.strip(chosen) == "") | (T.strip(rejected) == ""), "empty")
        .when(T.strip(chosen) == T.strip(rejected), "same")
        .when((F.length(T.strip(chosen)) < min_chars) | (F.length(T.strip(rejected)) < min_chars), "short")
        .when(F.length(prompt) > max_prompt, "long_prompt")
        .otherwise("kept")
    )


def pair_of_messages(prompt: Column, chosen: Column, rejected: Column, system: str) -> Column:
    """``messages, chosen, rejected`` from a prompt and two exchanges that end in an answer, else null."""
    def answer(m: Column) -> Column:
        last = F.try_element_at(m, F.lit(-1))
        return F.when((F.lower(last["role"]) == "assistant") & (T.strip(last["content"]) != ""), T.newlines(last["content"]))

    good = (T.strip(prompt) != "") & answer(chosen).isNotNull() & answer(rejected).isNotNull()
    messages = F.array(turn("system", system), turn("user", T.strip(T.newlines(prompt))))
    return F.when(good, F.struct(messages.alias("messages"), answer(chosen).alias("chosen"), answer(rejected).alias("rejected")))


def pair_of_answers(system: Column, question: Column, chosen: Column, rejected: Column, default: str) -> Column:
    """The same from plain texts; a blank system text becomes the default."""
    good = (T.strip(question) != "") & (T.strip(chosen) != "") & (T.strip(rejected) != "")
    lead = F.coalesce(F.nullif(T.strip(system), F.lit("")), F.lit(default))
    messages = F.array(turn("system", lead), turn("user", T.strip(T.newlines(question))))
    return F.when(good, F.struct(messages.alias("messages"), T.newlines(chosen).alias("chosen"), T.newlines(rejected).alias("rejected")))
