"""Label, role and text functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label set, in the order that breaks ties
EMOTIONS = ("joy", "trust", "fear", "surprise", "sadness", "disgust", "anger", "anticipation")
# The subtypes as predictions name them, and as gold names them
SUBTYPES = ("sarcasm_irony", "mixed_signals", "strategic_politeness", "passive_aggression", "deflection")
GOLD_SUBTYPES = {
    "sarcasm-irony": "sarcasm_irony",
    "mixed-signals": "mixed_signals",
    "strategic-politeness": "strategic_politeness",
    "passive-aggression": "passive_aggression",
    "deflection-misdirection": "deflection",
}
# Labels outside the set and what they are mapped to, with the reason
LABEL_MAP = {
    "guilt": ("sadness", "Self-directed negative emotion, Plutchik secondary"),
    "disappointment": ("sadness", "Unmet expectation, sadness variant"),
    "anxiety": ("fear", "Fear of future threat"),
    "embarrassment": ("fear", "Social threat response, anxiety-related"),
    "concern": ("fear", "Worry about negative outcome"),
    "discomfort": ("fear", "Unease, mild fear response"),
    "distrust": ("fear", "Opposite of trust, fear-based caution"),
    "uncertainty": ("fear", "Unknown threat response"),
    "stress": ("fear", "Physiological fear response"),
    "defensive": ("fear", "Self-protection from threat"),
    "frustration": ("anger", "Blocked goal, anger precursor"),
    "annoyance": ("anger", "Mild anger, irritation"),
    "relief": ("joy", "Positive resolution of tension"),
    "amusement": ("joy", "Positive affect, humor response"),
    "gratitude": ("joy", "Positive social emotion"),
}
RETRY_LABELS = ("unknown",)
# Valence markers
POSITIVE = ("great", "happy", "love", "wonderful", "excellent", "thank", "appreciate", "glad", "sure", "yes")
NEGATIVE = ("no", "not", "never", "hate", "terrible", "bad", "sorry", "unfortunately", "problem", "issue")
# Fixed values: (high, low) role words of the four vocabularies
ROLE_WORDS = {
    "gold": (
        "senior manager director supervisor lead chief executive boss owner president vp head ceo cto cfo partner principal dean professor".split(),
        "junior intern trainee assistant new entry apprentice student rookie associate aide clerk".split(),
    ),
    "rsa": (
        "manager supervisor director ceo boss senior lead head chief partner".split(),
        "junior intern assistant associate employee subordinate trainee new".split(),
    ),
    "efficiency": (
        "manager supervisor director senior lead boss".split(),
        "junior intern assistant associate new trainee".split(),
    ),
    "composition": (
        "manager supervisor director ceo boss senior lead head chief partner executive".split(),
        "junior intern assistant associate employee subordinate trainee new entry".split(),
    ),
}
# Provider rules in order, and calls allowed at once
PROVIDERS = (
    ("openai", ("gpt", "o1-", "o3-")),
    ("anthropic", ("claude",)),
    ("google", ("gemini",)),
    ("xai", ("grok",)),
    ("fireworks", ("accounts/fireworks", "kimi", "qwen", "deepseek", "minimax", "glm")),
    ("together", ("meta-llama", "mistralai", "google/gemma")),
)
PROVIDER_LIMITS = {"openai": 50, "anthropic": 40, "google": 60, "xai": 20, "fireworks": 10, "together": 10, "ollama": 5}
DEFAULT_LIMIT = 5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def normalise(label) -> Column:
    """Lower case without surrounding blanks; null becomes the empty string."""
    return F.coalesce(F.lower(F.trim(_col(label))), F.lit(""))


def label_action(label) -> Column:
    """valid, retry, mapped or unknown."""
    x = normalise(label)
    return F.when(x == "", "unknown").when(x.isin(*EMOTIONS), "valid").when(x.isin(*RETRY_LABELS), "retry").when(x.isin(*LABEL_MAP), "mapped").otherwise("unknown")


def _lookup(x: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), x)


def mapped_label(label) -> Column:
    """The label itself if valid, its synonym in the set if mapped, else null."""
    x = normalise(label)
    return F.when(x.isin(*EMOTIONS), x).otherwise(_lookup(x, {k: v[0] for k, v in LABEL_MAP.items()}))


def mapping_reason(label) -> Column:
    return _lookup(normalise(label), {k: v[1] for k, v in LABEL_MAP.items()})


def marker_counts(text) -> tuple[Column, Column]:
    """(positive, negative): how many different markers a text holds as substrings."""
    x = F.lower(_col(text))
    count = lambda words: sum((x.contains(w).cast("int") for w in words), F.lit(0))
    return count(POSITIVE), count(NEGATIVE)


def valence(text) -> Column:
    p, n = marker_counts(text)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def power_relation(speaker, listener, vocabulary: str = "gold") -> Column:
    """peer, higher_to_lower or lower_to_higher by role words found as substrings.

    The ``gold`` vocabulary also decides on one high side alone; the others need
    both sides, and look for a low speaker first.
    """
    high, low = ROLE_WORDS[vocabulary]
    s, o = F.lower(_col(speaker)), F.lower(_col(listener))
    sh, sl, oh, ol = _any(s, high), _any(s, low), _any(o, high), _any(o, low)
    if vocabulary == "gold":
        return F.when(sh & ol, "higher_to_lower").when(sl & oh, "lower_to_higher").when(sh & ~oh, "higher_to_lower").when(oh & ~sh, "lower_to_higher").otherwise("peer")
    return F.when(sl & oh, "lower_to_higher").when(sh & ol, "higher_to_lower").otherwise("peer")


def provider(model) -> Column:
    x = F.lower(_col(model))
    return reduce(lambda a, rule: a.when(_any(x, rule[1]), rule[0]), PROVIDERS[1:], F.when(_any(x, PROVIDERS[0][1]), PROVIDERS[0][0])).otherwise("mock")


def provider_limit(name) -> Column:
    return F.coalesce(_lookup(_col(name), PROVIDER_LIMITS), F.lit(DEFAULT_LIMIT))


def sentiment_band(score) -> Column:
    """Label for a compound sentiment score."""
    s = _col(score)
    return F.when(s >= 0.5, "joy").when(s >= 0.1, "trust").when(s <= -0.5, "anger").when(s <= -0.1, "sadness").otherwise("anticipation")


def quoted(text) -> Column:
    """The first double-quoted stretch of a text, else all of it."""
    q = F.regexp_extract(_col(text), '"([^"]+)"', 1)
    return F.when(q != "", q).otherwise(_col(text))


RESPONSE_SCHEMA = "subtype string, emotion string, valence double, arousal double, dominance double, confidence double"


def response_object(text) -> Column:
    """The first brace group without nested braces, inside the code fence if there is one; null if none."""
    x = F.trim(_col(text))
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    inner = F.regexp_extract(F.when(fenced != "", fenced).otherwise(x), r"(?s)(\{[^{}]*\})", 1)
    return F.when(inner != "", inner)


def parsed_response(text) -> Column:
    """Struct of the six prediction fields; whatever can't be read gives unknown labels and zeros.

    A missing subtype falls back to the emotion. Explicit JSON nulls count as missing.
    """
    v = F.try_parse_json(response_object(text))
    get = lambda f, kind: F.try_variant_get(v, f"$.{f}", kind)
    bad = v.isNull() | reduce(lambda a, b: a | b, [get(f, "string").isNotNull() & get(f, "double").isNull() for f in ("valence", "arousal", "dominance")])
    emotion = get("emotion", "string")
    fields = [
        F.when(bad, "unknown").otherwise(F.coalesce(get("subtype", "string"), emotion, F.lit("unknown"))).alias("subtype"),
        F.when(bad, "unknown").otherwise(F.coalesce(emotion, F.lit("unknown"))).alias("emotion"),
        *[F.when(bad, 0.0).otherwise(F.coalesce(get(f, "double"), F.lit(0.0))).alias(f) for f in ("valence", "arousal", "dominance")],
        F.when(~bad, get("confidence", "double")).alias("confidence"),
    ]
    return F.struct(*fields)


def prompt_hash(text) -> Column:
    return F.sha2(_col(text), 256)


def cache_path(model, scenario, intervention, digest) -> Column:
    """<model>/scenario_<id>[_<intervention>][_<8 of digest>].json with slashes and backslashes as underscores in the model."""
    safe = F.translate(_col(model), "/\\", "__")
    tail = F.concat(F.coalesce(F.concat(F.lit("_"), _col(intervention)), F.lit("")), F.coalesce(F.concat(F.lit("_"), F.substring(_col(digest), 1, 8)), F.lit("")))
    return F.concat(safe, F.lit("/scenario_"), _col(scenario).cast("string"), tail, F.lit(".json"))


def scenario_type(scenario) -> Column:
    """What stands before the last underscore, else unknown."""
    x = _col(scenario)
    return F.when(x.contains("_"), F.regexp_extract(x, r"(?s)^(.*)_[^_]*$", 1)).otherwise("unknown")


def backoff(attempt, base: float = 2.0, most: float = 60.0, jitter: float = 0.25, seed_cols: tuple = ()) -> Column:
    """Seconds before a retry: base * 2**attempt up to ``most``, jittered by a hash of ``seed_cols``, 0.1 at least."""
    d = F.least(F.lit(base) * F.pow(F.lit(2.0), _col(attempt)), F.lit(most))
    if seed_cols:
        u = F.pmod(F.xxhash64(*seed_cols), F.lit(1 << 30)).cast("double") / float(1 << 30)
        d = d * (1 + jitter * (2 * u - 1))
    return F.greatest(F.lit(0.1), d)


def band(value, cuts: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """names[i] for the first cut that value is below, the last name above all."""
    v = _col(value)
    return reduce(lambda a, i: a.when(v < cuts[i], names[i]), range(1, len(cuts)), F.when(v < cuts[0], names[0])).otherwise(names[-1])


def effect_band(d, kind: str = "d") -> Column:
    cuts = {"d": (0.2, 0.5, 0.8), "delta": (0.147, 0.33, 0.474)}[kind]
    return band(F.abs(_col(d)), cuts, ("negligible", "small", "medium", "large"))


def kappa_band(k) -> Column:
    return band(k, (0.0, 0.2, 0.4, 0.6, 0.8), ("poor", "slight", "fair", "moderate", "substantial", "almost perfect"))


def v_band(v, kind: str = "efficiency") -> Column:
    if kind == "efficiency":
        return band(v, (0.1, 0.3, 0.5), ("negligible", "small", "medium", "large"))
    return band(v, (0.3, 0.5), ("small", "medium", "large"))


def correlation_band(r) -> Column:
    return F.concat(band(F.abs(_col(r)), (0.3, 0.6), ("weak", "moderate", "strong")), F.when(_col(r) > 0, " positive").otherwise(" negative"))


def p_stars(p) -> Column:
    return band(p, (0.001, 0.01, 0.05), ("***", "**", "*", ""))


def ece_band(e) -> Column:
    return band(e, (0.05, 0.15), ("well calibrated", "moderately calibrated", "poorly calibrated"))


def listener_band(k0, k1) -> Column:
    """Which listener the predictions are nearer to, by more than 0.1 of kappa."""
    a, b = _col(k0), _col(k1)
    return F.when(a > b + 0.1, "literal").when(b > a + 0.1, "pragmatic").otherwise("mixed")
