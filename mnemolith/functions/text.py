"""Text functions over columns. Words are what lies between white space, without empty ones; lengths are in UTF-8 bytes unless said otherwise."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u0085   -     　]+"

# Phrases that tell what kind of memory a text is.
RULE = ["must", "always", "never", "required", "shall", "constraint", "invariant", "rule:", "important:", "critical:", "forbidden", "mandatory", "do not", "don't", "ensure that", "make sure"]
PROCEDURE = ["step 1", "step 2", "first", "then", "finally", "how to", "to do this", "process:", "workflow:", "steps:", "run the", "execute", "install", "configure", "setup", "create a", "deploy", "build the"]
PREFERENCE = ["prefer", "like", "dislike", "favorite", "rather", "style:", "prefer to", "would rather", "choose", "instead of", "better than", "worse than"]
EPISODE = ["yesterday", "today", "last week", "on monday", "happened", "occurred", "we did", "we found", "discovered", "resolved", "fixed the", "broke", "incident", "session", "meeting"]
# Words without weight, marks around words.
STOP_WORDS = ["the", "and", "for", "that", "this", "with", "from", "have", "been", "they"]
MARKS = ".,;:\"'()"
HEADING_MARKS = ".,;:!?()[]{}\"'`"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")


def estimate_tokens(text: Column) -> Column:
    """A guess from words and bytes, rounded down; 0 for an empty text."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    guess = F.greatest(F.size(words(text)) * F.lit(1.25), size / F.lit(3.5)) * F.lit(1.1)
    return F.when(size == 0, 0).otherwise(guess.cast("long")).cast("long")


def truncate_to_budget(text: Column, budget: Column | int) -> Column:
    """The text if its estimate is within ``budget`` tokens, else its first bytes up to the last space past the middle, and an ellipsis."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    most = (budget * F.lit(3.5) / F.lit(1.1)).cast("int")
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), most), "UTF-8")
    head = F.regexp_replace(head, "�+$", "")
    last = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (last > most / 2), F.left(head, last)).otherwise(head)
    return F.when(budget <= 0, "").when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def _mention(phrase: str) -> str:
    """Pattern of a phrase up to an ASCII word boundary."""
    return f"{re.escape(phrase)}{'(?![0-9A-Za-z_])' if phrase[-1].isalnum() else '(?=[0-9A-Za-z_])'}"


def mentions(text: Column, phrases: list[str]) -> Column:
    """Those of the phrases that stand in the text between ASCII word boundaries, in any case, in one pass over the text.

    Of phrases that begin alike the longest is met first at a place; the shorter ones that it holds are added."""
    by_letter: dict[str, list[str]] = {}
    for p in sorted(set(phrases), key=lambda p: (-len(p), p)):
        by_letter.setdefault(p[0], []).append(_mention(p)[1:])
    any_of = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in sorted(by_letter.items()))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i)(?<![0-9A-Za-z_])(?=({any_of}))"), F.lit(1)), F.lower)
    for p in phrases:
        within = [q for q in phrases if q != p and re.match(_mention(q), p)]
        if within:
            found = F.concat(found, F.when(F.array_contains(found, p), F.array(*map(F.lit, within))).otherwise(F.array().cast("array<string>")))
    return found


def classify(text: Column) -> Column:
    """The type with most phrases; among equals rule, procedure, preference, episode; fact if there are none."""
    kinds = {"rule": RULE, "procedure": PROCEDURE, "preference": PREFERENCE, "episode": EPISODE}

    def best(found: Column) -> Column:
        scores = {kind: F.size(F.array_intersect(found, F.array(*map(F.lit, phrases)))) for kind, phrases in kinds.items()}
        most = F.greatest(*scores.values())
        out = F.when(most == 0, "fact")
        for kind, score in scores.items():
            out = out.when(score == most, kind)
        return out

    # As the element of an array, what is found is made once for all four scores.
    return F.transform(F.array(mentions(F.coalesce(text, F.lit("")), [p for phrases in kinds.values() for p in phrases])), best)[0]


def capture_gate(user: Column, assistant: Column, least_user: int = 20, least_assistant: int = 20, blocked: tuple[str, ...] = ("HEARTBEAT_OK", "NO_REPLY")) -> Column:
    """Whether a turn is worth keeping: both sides long enough and free of blocked phrases."""
    keep = (F.octet_length(trimmed(user)) >= least_user) & (F.octet_length(trimmed(assistant)) >= least_assistant)
    for phrase in blocked:
        keep = keep & ~F.contains(F.coalesce(user, F.lit("")), F.lit(phrase)) & ~F.contains(F.coalesce(assistant, F.lit("")), F.lit(phrase))
    return keep


def confident(confidence: Column, least: float = 0.5) -> Column:
    """Whether a captured memory is sure enough to keep; never for an unknown confidence."""
    return F.coalesce(confidence >= least, F.lit(False))


def healthy(checks: list[Column]) -> Column:
    """Whether no check failed; one that was skipped (null) counts as passed."""
    out = F.lit(True)
    for check in checks:
        out = out & F.coalesce(check, F.lit(True))
    return out


def strip_marks(word: Column, marks: str) -> Column:
    return F.btrim(word, F.lit(marks))


def significant_words(text: Column) -> Column:
    """Lower-case words of four bytes or more without the marks around them, stop words left out."""
    bare = F.transform(words(F.lower(text)), lambda w: strip_marks(w, MARKS))
    return F.filter(bare, lambda w: (F.octet_length(w) >= 4) & ~w.isin(STOP_WORDS))


def sanitise_query(query: Column) -> Column:
    """A search query with the characters of the search syntax as spaces."""
    special = "+-&|!(){}[]^\"~*?:\\/"
    return F.translate(query, special, " " * len(special))


def xml_escape(text: Column) -> Column:
    # Characters and their references.
    for char, ref in (("&", "&amp;"), ('"', "&#34;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def strip_code_fences(text: Column) -> Column:
    body = trimmed(text)
    inner = F.regexp_extract(body, r"(?s)^```[^\n]*\n(.*?)(?:\n?```\s*)?$", 1)
    return F.when(F.startswith(body, F.lit("```")), trimmed(inner)).otherwise(body)


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters on one line."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("..."))).otherwise(flat)


def heading_tags(heading: Column, path: Column) -> Column:
    """The file's name without its ending, then the heading's words of more than two bytes."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    of_heading = F.filter(F.transform(words(F.lower(heading)), lambda w: strip_marks(w, HEADING_MARKS)), lambda w: F.octet_length(w) > 2)
    return F.concat(F.when(stem != "", F.array(stem)).otherwise(F.array().cast("array<string>")), of_heading)


EVAL_WORD = re.compile(r"[a-z0-9']+")


def eval_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9']+)"), F.lit(1))


def exact_match(retrieved: Column, truth: Column) -> Column:
    """Whether the truth stands in what was retrieved, in any case; never for an empty truth."""
    return F.coalesce((truth != "") & F.contains(F.lower(retrieved), F.lower(truth)), F.lit(False))


def token_f1(retrieved: Column, truth: Column) -> Column:
    """F1 of the two bags of words; 0 if either is empty or nothing is shared. Bags are counted batch by batch in Python."""

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = (Counter(EVAL_WORD.findall(t or "")) for t in (a, b))
            shared = (x & y).total()
            out.append(2.0 * shared / (x.total() + y.total()) if shared else 0.0)
        return pd.Series(out, dtype=float)

    return score(F.lower(retrieved), F.lower(truth))


def recall_at_k(retrieved: Column, truth: Column, k: int) -> Column:
    """Whether one of the first ``k`` retrieved texts has the truth in it."""
    return F.exists(F.slice(retrieved, 1, k), lambda r: exact_match(r, truth))


def normalise_category(raw: Column) -> Column:
    text = F.lower(trimmed(raw))
    return F.when(text == "temporal reasoning", "temporal").otherwise(text)


def normalise_question_type(raw: Column) -> Column:
    text = F.lower(trimmed(raw))
    return F.when(text == "temporal reasoning", "temporal").when(text.isin("multi_hop", "multihop"), "multi-hop").when(text.isin("knowledge_update", "knowledge update"), "knowledge-update").otherwise(text)


def hop_category(hops: Column) -> Column:
    return F.when(F.coalesce(hops, F.lit(0)) <= 0, "unknown").otherwise(F.concat(hops.cast("string"), F.lit("-hop")))


def member_or(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def parse_store_output(text: Column) -> Column:
    """(status, id) of a line that reports a stored record."""
    uuid = F.regexp_extract(text, r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})", 1)
    low = F.lower(text)
    status = F.when(F.contains(low, F.lit("duplicate")) | F.contains(low, F.lit("skip")), "skipped").when(F.contains(low, F.lit("updat")), "updated").when(uuid != "", "created")
    return F.struct(status.alias("status"), F.nullif(uuid, F.lit("")).alias("id"))


def metadata_json(text: Column) -> Column:
    """The text if it is JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)
