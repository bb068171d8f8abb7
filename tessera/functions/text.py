"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"

# Word lists, type names and label names that results depend on.
ENTITY_TYPES = ["character", "group", "location", "environment_element", "item", "event"]
TYPE_SYNONYMS = {"location_element": "location", "place": "location", "person": "character", "human": "character", "object": "item", "thing": "item", "env_element": "environment_element", "natural_feature": "environment_element"}
LABELS = {
    "PERSON": "character", "CHARACTER": "character", "CHAR": "character", "HERO": "character",
    "ORG": "group", "GROUP": "group", "FACTION": "group",
    "GPE": "location", "LOC": "location", "FAC": "location", "LOCATION": "location",
    "PRODUCT": "item", "ITEM": "item", "OBJECT": "item", "ANIMAL": "item",
    "EVENT": "event", "ACTION": "event", "ENV": "environment_element", "ENV_ELEMENT": "environment_element",
}
LEXICON = [
    ("character", "names", ["maria", "john", "anna", "mister", "miss", "mr", "mrs", "ms", "dr", "sir", "lord", "lady"]),
    ("character", "roles", ["girl", "boy", "woman", "man", "child", "daughter", "son", "mother", "father", "mom", "dad", "brother", "sister", "friend", "stranger", "hero", "villain"]),
    ("item", "animals", ["cat", "dog", "bird", "horse", "wolf", "bear", "rabbit", "fox", "demon", "angel"]),
    ("item", "objects", ["notebook", "book", "key", "sword", "rock", "bed", "door", "window", "lamp", "torch", "potion", "coin", "gem", "ring", "map", "compass"]),
    ("item", "rooms", ["bedroom", "kitchen", "bathroom", "hall", "cellar", "attic", "room"]),
    ("environment_element", "parts", ["wall", "ceiling", "floor", "path", "trail", "entrance", "exit", "stairs", "roof", "chimney", "fence", "gate", "corner", "window", "door"]),
    ("event", "nominalizations", ["battle", "arrival", "departure", "death", "meeting", "fight", "journey", "wedding", "funeral", "ceremony", "attack", "rescue", "discovery"]),
]
PRONOUNS = [
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
]
GENERIC_VERBS = [
    "be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "can", "tell", "let", "lets", "go", "going", "come", "look", "looking", "sit", "sitting", "stay", "staying", "walk", "walking", "run",
    "running", "appear", "appeared", "found", "lost",
]
ABSTRACT_NOUNS = [
    "world", "fact", "history", "details", "event", "gameplay", "while", "stuff", "thing", "part", "place", "time", "way", "day", "night", "life",
    "system", "process", "state", "scene", "finish", "finishes", "cutie", "dear", "ancient", "greatest", "little", "angel",
]
LINK_WORDS = "of|and|or|but|in|on|at|to|for|with|by|from|into|upon|without"
STOP_SPANS = "why|oh|wow|yes|no|ok|the|a|an|and|but|or|in|on|at|to|for|with|by|from|is|are|was|were"
ITEM_HINTS = ["key", "book", "note"]
BEING_HINTS = ["cat", "demon", "girl", "boy", "mom", "dad"]
SPAN_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ —–"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def create_id(name: Column, unicode_ids: bool = False) -> Column:
    """Letters and white space only, trimmed, runs of white space as _, lower case."""
    keep = r"[^\p{L}\p{N}\s]" if unicode_ids else r"[^A-Za-zА-Яа-я\s]"
    bare = F.regexp_replace(F.regexp_replace(name, keep, ""), r"^\s+|\s+$", "")
    return F.lower(F.regexp_replace(bare, r"\s+", "_"))


def clean_name(name: Column) -> Column:
    """White space collapsed, quotes stripped, one leading article dropped."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    bare = F.regexp_replace(squeeze(name), r"^[\"']+|[\"']+$", "")
    return squeeze(F.regexp_replace(bare, r"(?i)^(a|an|the)\s+", ""))


def clean_string(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-zА-Яа-яЁё\s]", "")


def tokens(text: Column) -> Column:
    """Estimated tokens: Latin or digit pieces by 3.5 characters, Cyrillic ones by 2.4, others 1; null and empty 0."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    # half-even rounding
    size = lambda x, per: F.greatest(F.lit(1), F.bround(F.length(x) / F.lit(per)).cast("int"))
    one = lambda x: F.when(x.rlike("^[A-Za-z0-9]+$"), size(x, 3.5)).when(x.rlike("^[А-Яа-яЁё]+$"), size(x, 2.4)).otherwise(1)
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, x: acc + one(x).cast("long"))


def entity_type(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(ENTITY_TYPES), v).otherwise(F.coalesce(_map(TYPE_SYNONYMS)[v], F.lit("item")))


def label_type(label: Column, overrides: dict[str, str] | None = None) -> Column:
    merged = {k.upper(): v for k, v in (LABELS | (overrides or {})).items()}
    return _map(merged)[F.upper(label)]


def span_clean(text: Column, label: Column, least: int = 2) -> Column:
    """struct(text, label) of a usable span, null of one to drop."""
    edge = "".join("\\" + c if not c.isalnum() and c != " " and ord(c) < 128 else c for c in SPAN_EDGES)
    t = F.regexp_replace(text, f"^[{edge}]+|[{edge}]+$", "")
    low = F.lower(t)
    has = lambda words: F.coalesce(F.greatest(*[F.contains(low, F.lit(w)) for w in words]), F.lit(False))
    lab = F.when((label == "location") & has(ITEM_HINTS), "item").when((label == "location") & has(BEING_HINTS), "character").otherwise(label)
    n = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    drop = (F.length(t) < least) | t.rlike(r"^[0-9]+$") | t.rlike(r"^\s*$") | t.rlike(f"(?i)^({STOP_SPANS})$")
    drop |= (lab == "character") & (n > 3) & ~t.rlike(r"(^|\s)\p{Lu}\p{Ll}*(\s|$)")
    drop |= (lab == "environment_element") & (F.length(t) < 4)
    return F.when(~drop, F.struct(t.alias("text"), F.lower(lab).alias("label")))


def span_reject(text: Column, lemma: Column | None = None) -> Column:
    """The reason to drop a span, null to keep it."""
    low = F.lower(F.trim(text))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))
    out = F.when(F.length(low) < 2, "too_short").when(F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS))) & (F.size(words) > 1), "contains_pronoun")
    if lemma is not None:
        out = out.when(F.lower(lemma).isin(GENERIC_VERBS), "generic_verb")
    return out.when(low.isin(ABSTRACT_NOUNS), "abstract_noun").when(low.rlike(rf"\b({LINK_WORDS})\b"), "contains_preposition")


def type_correct(text: Column, predicted: Column, lemma: Column | None = None) -> Column:
    """struct(type, reason): the first lexicon entry that holds the text or its lemma, else the prediction."""
    low = F.lower(F.trim(text))
    lem = F.lower(lemma) if lemma is not None else low
    out = None
    for kind, category, words in LEXICON:
        hit = low.isin(words) | lem.isin(words)
        value = F.struct(F.lit(kind).alias("type"), F.lit(f"lexicon_override:{category}").alias("reason"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(predicted.alias("type"), F.lit("no_override").alias("reason")))


def pick_name(a: Column, b: Column, priority: list[str] | None = None) -> Column:
    """Of two names: one on the priority list, then the longer, the capitalised, the first in order."""
    rank = lambda x: F.struct((-F.length(x)).alias("l"), F.when(x.rlike(r"^\p{Lu}"), 0).otherwise(1).alias("c"), F.lower(x).alias("n"))
    best = F.when(rank(a) <= rank(b), a).otherwise(b)
    if priority:
        best = F.when(F.lower(a).isin(priority), a).when(F.lower(b).isin(priority), b).otherwise(best)
    return best


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def lexical_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    lev = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    p, q = (F.array_distinct(F.regexp_extract_all(v, F.lit(WORD), F.lit(0))) for v in (x, y))
    union = F.size(F.array_union(p, q))
    return (lev + F.when(union > 0, F.size(F.array_intersect(p, q)) / union).otherwise(0.0)) / 2


def hybrid_similarity(a: Column, b: Column, type_a: Column, type_b: Column, cos: Column, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    part = (F.contains(x, y) | F.contains(y, x)) & (x != y)
    kind = F.when(type_a != type_b, 0.0).when(part, 0.9).otherwise(1.0)
    return weights[0] * cos + weights[1] * lexical_similarity(a, b) + weights[2] * kind


def answer_body(text: Column, tag: str) -> Column:
    """The tag's body of a reply, else the reply without reasoning blocks and stray tags."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^```([A-Za-z0-9_]+)?\s*\n?", ""), r"```\s*$", "")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    t = strip(t)
    body = rf"(?is)<{tag}\s*>(.*?)</\s*{tag}\s*>"
    rest = F.regexp_replace(t, r"(?is)<reasoning\s*>.*?</\s*reasoning\s*>", "")
    rest = F.regexp_replace(rest, rf"(?i)<{tag}\s*>|</\s*{tag}\s*>|<reasoning\s*>|</\s*reasoning\s*>", "")
    rest = F.regexp_replace(rest, r"\n{3,}", "\n\n")
    return F.when(t.rlike(body), strip(F.regexp_extract(t, body, 1))).otherwise(strip(rest))


def score_parse(reply: Column) -> Column:
    """The first number of a reply within 0..1, 0 without one."""
    found = F.regexp_extract(F.coalesce(reply, F.lit("")), r"([0-9]*\.?[0-9]+)", 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found.try_cast("double"), F.lit(0.0))))


def ngrams(text: Column, n: int) -> Column:
    """Lower-case word n-grams, joined by a space."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    none = F.array().cast("array<string>")
    return bound(words, lambda w: F.when(F.size(w) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))
