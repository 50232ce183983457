"""Text, key and date normalisation as column expressions (no UDFs).

Python's ``\\s`` and ``\\w`` are Unicode classes, hence the ``(?U)`` flags.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Predicate spellings that mean the same relation (after "_" -> " ").
PREDICATE_ALIASES = {
    "live in": "lives_in", "lives in": "lives_in", "living in": "lives_in", "resides in": "lives_in",
    "residence": "lives_in", "current residence": "lives_in", "current location": "lives_in",
    "home": "lives_in", "home city": "lives_in", "based in": "lives_in", "location": "lives_in",
    "moved to": "lives_in", "move to": "lives_in",
    "will stay in": "stays_in", "stay in": "stays_in", "stays in": "stays_in",
}
# Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
# Words ignored in retrieval.
STOP_WORDS = ("the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "is", "are", "was", "were", "what",
              "when", "where", "who", "which", "does", "do", "did", "my", "me", "i", "you")
# Number words of relative dates.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
# Characters stripped from both ends of compared text.
EDGE_CHARACTERS = " .,!?:;\"'"


def lookup(pairs: dict[str, str]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def strip(value: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def squeeze(value: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def canonical_text(value: Column) -> Column:
    """Comparison form: lower case, single blanks, no edge punctuation."""
    return F.btrim(squeeze(F.lower(value)), F.lit(EDGE_CHARACTERS))


def normalize_predicate(value: Column) -> Column:
    """Known spellings to their label, everything else to snake case."""
    key = F.replace(canonical_text(value), F.lit("_"), F.lit(" "))
    snake = F.btrim(F.regexp_replace(key, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.try_element_at(lookup(PREDICATE_ALIASES), key), snake)


def claim_key(subject: Column, predicate: Column) -> Column:
    """Identity of the belief a claim is about; null if its subject or predicate is missing or blank."""
    parts = F.nullif(canonical_text(subject), F.lit("")), F.nullif(normalize_predicate(predicate), F.lit(""))
    return F.concat(parts[0], F.lit("::"), parts[1])


def parse_month_year(text: Column) -> Column:
    """First "March 2026" in a text as the first of that month."""
    found = r"(?i)\b(" + "|".join(MONTHS) + r")\s+(\d{4})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(text, found, 1)))
    year = F.regexp_extract(text, found, 2)
    return F.when(month > 0, F.try_make_date(year.try_cast("int"), month.cast("int"), F.lit(1)) if hasattr(F, "try_make_date")
                  else F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lit("01")).try_cast("date"))


def parse_iso_date(value: Column) -> Column:
    """YYYY-MM-DD exactly; anything else is null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def find_date(text: Column) -> Column:
    """First YYYY-M-D or YYYY/M/D inside a text; null if absent or not a date."""
    form = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    parts = [F.regexp_extract(text, form, i) for i in (1, 2, 3)]
    joined = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(text.rlike(form), joined.try_cast("date"))


def distinct_nonempty(values: Column) -> Column:
    """Order-preserving distinct without empty strings."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def shorten(value: Column, limit: int = 140) -> Column:
    """First ``limit`` characters, "..." added when something was cut."""
    text = squeeze(value)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def compact(value: Column, limit: int) -> Column:
    """At most ``limit`` characters, the dots included."""
    text = squeeze(value)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def source_label(ref: Column, excerpt: Column, source_id: Column) -> Column:
    """A readable name: the reference unless it is a generated one, else a short excerpt."""
    ref_text = F.coalesce(ref, F.lit(""))
    generated = ref_text.startswith("demo-ui:") | ref_text.startswith("chat") | ref_text.startswith("source-")
    quote = shorten(F.coalesce(excerpt, F.lit("")))
    return (
        F.when((ref_text != "") & ~generated, ref_text)
        .when(quote != "", quote)
        .when(ref_text != "", ref_text)
        .otherwise(F.concat(F.lit("source-"), source_id.cast("string")))
    )


def safe_branch_name(value: Column, keep_apart: bool = False) -> Column:
    """Lower-case letters, digits and single dashes, at most 40 characters; ``main`` if nothing is left.

    A longer name keeps its first 40 characters; with ``keep_apart`` 31 of them and eight of its md5, so that names with the
    same start differ.
    """
    name = F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))
    name = F.regexp_replace(name, r"[^\p{L}\p{N}-]", "")
    name = F.btrim(F.regexp_replace(name, "-+", "-"), F.lit("-"))
    short = F.concat(F.substring(name, 1, 31), F.lit("-"), F.substring(F.md5(name), 1, 8)) if keep_apart else F.substring(name, 1, 40)
    name = F.when(F.length(name) > 40, short).otherwise(name)
    return F.when(name == "", F.lit("main")).otherwise(F.coalesce(name, F.lit("main")))


def raw_tokens(text: Column) -> Column:
    """All ``[a-z0-9]+`` runs of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def stem(token: Column) -> Column:
    """Light suffix stripping used for retrieval only."""
    size = F.length(token)

    def cut(n: int, tail: str = "") -> Column:
        head = F.substring(token, F.lit(1), size - n)
        return F.concat(head, F.lit(tail)) if tail else head

    return (
        F.when(token.rlike("^[0-9]+$") | (size <= 3), token)
        .when((size > 6) & token.endswith("ated"), cut(4, "ate"))
        .when((size > 5) & token.endswith("ing"), cut(3))
        .when((size > 4) & token.endswith("ed"), cut(2))
        .when((size > 5) & token.endswith("ies"), cut(3, "y"))
        .when((size > 4) & token.endswith("s"), cut(1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """Set of stemmed retrieval tokens, stop words left out."""
    words = F.regexp_extract_all(canonical_text(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    kept = F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.array_distinct(F.transform(kept, stem))


def relative_date_targets(question: Column, asked_on: Column) -> Column:
    """Dates meant by "N days/weeks/months ago" (a month being 30 days) and "yesterday"."""
    low = F.lower(question)
    form = r"\b(\d+|" + "|".join(NUMBER_WORDS) + r")\s+(days?|weeks?|months?)\s+ago\b"
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])

    def days_back(phrase: Column) -> Column:
        amount = F.regexp_extract(phrase, form, 1)
        number = F.coalesce(amount.try_cast("int"), F.array_position(words, amount).cast("int"))
        unit = F.substring(F.regexp_extract(phrase, form, 2), 1, 1)
        return F.date_sub(asked_on, number * F.when(unit == "d", 1).when(unit == "w", 7).otherwise(30))

    phrases = F.regexp_extract_all(low, F.lit("(" + form + ")"), F.lit(1))
    found = F.transform(phrases, days_back)
    yesterday = F.when(F.contains(low, F.lit("yesterday")), F.array(F.date_sub(asked_on, 1))).otherwise(F.expr("cast(array() as array<date>)"))
    return F.when(asked_on.isNotNull(), F.concat(found, yesterday)).otherwise(F.expr("cast(array() as array<date>)"))
