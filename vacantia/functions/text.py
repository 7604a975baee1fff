"""Text columns: trimming, whole-token tests, key normalisers, the location rule."""

import json
import re

from pyspark.sql import Column, functions as F

from .. import vocab

# Characters stripped from both ends of a text: every Unicode white-space character.
SPACES = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
          + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")
# A word character is a letter, a number or an underscore of any script; Java's own \w and \b
# are ASCII only, so the classes are spelled out.
_WORD = r"[\p{L}\p{N}_]"
_GAP = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def any_spaced(pattern: str) -> str:
    """A case-blind pattern written for text with single spaces -> one for lower-cased text with
    any white space between words."""
    return pattern.removeprefix("(?i)").replace(" ", r"\s+").replace(r"\s", _GAP)


def either_empty(c: Column) -> Column:
    """Null and '' both count as missing."""
    return c.isNull() | (c == "")


def present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def literal_list(items) -> Column:
    """Array constant, folded at planning."""
    return F.from_json(F.lit(json.dumps(list(items))), "array<string>")


def literal_map(table: dict, value_type: str) -> Column:
    """Map constant with text keys, folded at planning."""
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{value_type}>")


def contains_any(c: Column, parts) -> Column:
    """Any part is a substring. A part that holds another part can be left out."""
    needed = [p for p in parts if not any(o != p and o in p for o in parts)]
    return any_of(c.contains, needed)


def any_of(test, items) -> Column:
    out = F.lit(False)
    for item in items:
        out = out | test(item)
    return out


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fenced(value: Column) -> Column:
    """`value`, kept from being copied. Catalyst moves a filter below a projection by copying the
    projected expression into it; for a long expression that means planning and computing it
    again per use. A projection with a partition-dependent part stays where it is."""
    return F.when(F.spark_partition_id() >= 0, value)


def _edged(pattern: str) -> str:
    return f"(?<!{_WORD})(?:{pattern})(?!{_WORD})"


def has_token(lowered: Column, term: str) -> Column:
    """Whole-token test. `contains` is a superset of the pattern and far cheaper, so the pattern
    only runs on rows that can match."""
    low = term.lower()
    return lowered.contains(low) & lowered.rlike(_edged(re.escape(low)))


def _token_scan(terms) -> str:
    """Pattern that matches the empty string where a term starts; group 1 is the term. Matching
    nothing, it finds overlapping terms, too ('gitlab ci' and 'ci/cd'). Terms share their first
    letter in the pattern, which keeps the alternatives tried per token few."""
    by_letter: dict[str, list[str]] = {}
    for low in dict.fromkeys(t.lower() for t in terms):
        by_letter.setdefault(low[0], []).append(re.escape(low[1:]))
    starts = "".join(by_letter)
    branches = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return f"(?=[{starts}])(?<!{_WORD})(?=({branches})(?!{_WORD}))"


def shadowed(terms) -> list[tuple[str, str]]:
    """Pairs where one term starts another and ends at a token edge in it. At such a place a scan
    would see one of the two only."""
    lows = [t.lower() for t in terms]
    return [(a, b) for a in lows for b in lows
            if a != b and b.startswith(a) and not (b[len(a)].isalnum() or b[len(a)] == "_")]


def tokens_found(lowered: Column, terms) -> Column:
    """Terms present as whole tokens, in dictionary order. One scan of the text finds all terms;
    only a dictionary with shadowed terms needs a test per term."""
    if shadowed(terms) or not all(t[0].isalnum() for t in terms):
        return F.array_compact(F.array(*[F.when(has_token(lowered, t), F.lit(t)) for t in terms]))
    none = F.array().cast("array<string>")

    def in_order(found):
        hits = F.filter(literal_list(terms), lambda t: F.array_contains(found, F.lower(t)))
        return F.when(F.size(found) == 0, none).otherwise(hits)

    return let(F.regexp_extract_all(lowered, F.lit(_token_scan(terms)), 1), in_order)


def substrings_found(lowered: Column, terms) -> Column:
    return F.array_compact(
        F.array(*[F.when(lowered.contains(t.lower()), F.lit(t)) for t in terms]))


def normalize_company(c: Column) -> Column:
    low = F.regexp_replace(F.lower(c), _edged("|".join(vocab.COMPANY_NOISE)), "")
    return F.coalesce(F.regexp_replace(low, "[^a-z0-9]", ""), F.lit(""))


def normalize_title(c: Column) -> Column:
    out = F.lower(c)
    for pattern in (r"\([^\n]*?\)", r"\[[^\n]*?\]", _edged(vocab.TITLE_NOISE), "[^a-z0-9]"):
        out = F.regexp_replace(out, pattern, "")
    return F.coalesce(out, F.lit(""))


def dedup_key(company: Column, title: Column) -> Column:
    """company:title, '' when either is empty."""
    both = F.array(normalize_company(company), normalize_title(title))
    return let(both, lambda parts: F.when(F.array_contains(parts, ""), F.lit("")).otherwise(
        F.array_join(parts, ":")))


def key_company(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def key_title(key: Column) -> Column:
    return F.substr(key, F.length(key_company(key)) + 2)


def city(location: Column) -> Column:
    """First non-blank comma part, or the whole text when every part is blank."""
    parts = F.filter(F.transform(F.split(location, ","), strip), lambda p: p != "")
    return F.coalesce(F.get(parts, 0), location)


def merge_locations(kept: Column, other: Column) -> Column:
    """Location of a posting after another copy of it was seen: only a new city is appended."""
    kept_low, city_low = F.lower(kept), F.lower(city(other))
    same = strip(kept_low) == strip(F.lower(other))
    known = (F.lower(city(kept)) == city_low) | kept_low.contains(city_low)
    return (
        F.when(either_empty(kept), F.coalesce(other, F.lit("")))
        .when(either_empty(other) | same | known, kept)
        .otherwise(F.concat(kept, F.lit(" / "), city(other)))
    )


def repost_flag(given: Column, posted_at: Column, description: Column) -> Column:
    hinted = (F.lower(F.coalesce(posted_at, F.lit(""))).contains("repost")
              | F.lower(F.substring(F.coalesce(description, F.lit("")), 1, 300))
              .contains("reposted"))
    return F.when(given.isNotNull(), (given != 0).cast("int")).otherwise(hinted.cast("int"))


def repost_shown(is_reposted: Column, posted_at: Column) -> Column:
    return ((F.coalesce(is_reposted, F.lit(0)) != 0)
            | F.lower(F.coalesce(posted_at, F.lit(""))).contains("repost"))


def any_contains(items: Column, part: Column) -> Column:
    """Whether one of the items holds the part."""
    return F.exists(items, lambda item: item.contains(part))


def csv_items(c: Column) -> Column:
    """Comma-separated form text -> trimmed, non-empty items."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip),
                    lambda item: item != "")


def plain_number(c: Column) -> Column:
    """4.0 -> '4', 1.5 -> '1.5'."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
