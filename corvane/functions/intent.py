"""What a question asks for: query type, asker profile, person look-ups, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import (
    collapse_space, contains_any, content_tokens, first_label, matches_any, slug, text_or_empty,
)

# Words and patterns of the question classifier.
REASONING = (
    r"\bwhy\b", r"\bcompare\b", r"\bcontrast\b", r"\bdifferences?\b", r"\brecommend\b", r"\bshould\b",
    r"\bbest\b", r"\bpros?\b", r"\bcons?\b", r"\btrade\s*-?\s*offs?\b", r"\bexplain\b",
    r"\banaly[sz]e\b", r"\bevaluate\b", r"\bhelp me choose\b",
)
FACTUAL = (
    r"\bwho\b", r"\bwhat\b", r"\bwhen\b", r"\bwhere\b", r"\bhow many\b", r"\bhow much\b",
    r"\bdeadline\b", r"\bdate\b", r"\btuition\b", r"\bfee\b", r"\bcost\b", r"\brequirements?\b",
    r"\bemail\b", r"\bphone\b", r"\bcontact\b", r"\baddress\b", r"\bhours?\b",
)
SCHOOL_WORDS = (
    "cox", "business", "mba", "lyle", "engineering", "meadows", "arts", "simmons", "education",
    "perkins", "theology", "law", "dedman", "graduate", "student",
)
COURSE_WORDS = ("course", "curriculum", "class")
MONEY_WORDS = ("fee", "tuition", "cost", "aid")
PROCESS_WORDS = ("admission", "apply", "application", "process")
ADMISSION_WORDS = ("admission", "apply", "application", "deadline")
GRADUATE_WORDS = ("grad", "graduate", "master", "mba")

# Ordered label -> needles, substring semantics.
EDUCATION = (
    ("early learner", ("middle school", "young", "kid", "early learner")),
    ("secondary student", ("high school", "secondary")),
    ("undergraduate", ("undergraduate", "freshman", "bachelor", "major")),
    ("graduate", ("graduate", "master", "phd", "doctoral")),
    ("professional", ("professional", "certificate", "executive")),
)
ROLE = (
    ("applicant", ("apply", "admission", "application", "applicant")),
    ("current student", ("current student", "registrar", "transcript")),
    ("parent", ("parent", "family")),
    ("researcher", ("research", "lab")),
    ("visitor", ("visit", "tour")),
)
INTENT = (
    ("apply", ("apply", "admission", "application", "deadline", "requirement")),
    ("pay", ("tuition", "fee", "cost", "financial aid", "scholarship")),
    ("study", ("program", "degree", "major", "course", "catalog")),
    ("contact", ("contact", "email", "phone", "office")),
    ("research", ("research", "lab", "faculty")),
    ("visit", ("visit", "tour")),
    ("enroll", ("registrar", "enroll", "transcript")),
)
INTEREST = (
    ("business", ("business", "mba")),
    ("computer", ("computer", "cs", "software")),
    ("engineering", ("engineering", "network engineering", "ece", "eets", "lyle")),
    ("science", ("science",)),
    ("arts", ("arts", "music", "theatre")),
    ("law", ("law",)),
)
PROFILE_FIELDS = (
    ("education_level", EDUCATION), ("role", ROLE), ("intent", INTENT), ("academic_interest", INTEREST),
)

# Hints for questions about a person, and query expansions.
LEADER_HINTS = (
    "director", "chair", "dean", "head of", "program director", "coordinator", "who is", "who's", "whos",
)
NETWORK_EXPANSIONS = (
    "network engineering", "ms-network-engineering", "ece", "eets", "lyle school of engineering",
    "electrical and computer engineering",
)
HOME_SCHOOL = "lyle school of engineering"

# School page folders and the words that ask for them.
SCHOOL_PAGES = (
    ("cox-school-of-business", ("cox", "business", "mba")),
    ("lyle-school-of-engineering", ("lyle", "engineering")),
    ("meadows-school-of-the-arts", ("meadows", "arts", "music", "theatre", "dance")),
    ("simmons-school-of-education", ("simmons", "education")),
    ("perkins-school-of-theology", ("perkins", "theology")),
    ("dedman-school-of-law", ("law", "dedman law")),
    ("dedman-college", ("dedman college", "humanities", "sciences")),
)


def normal(query: Column) -> Column:
    return F.lower(collapse_space(text_or_empty(query)))


def query_type(query: Column) -> Column:
    """``struct(query_type, classifier_reason)``; rules in order."""
    q = normal(query)
    multi = (
        contains_any(q, SCHOOL_WORDS) & contains_any(q, COURSE_WORDS)
        & contains_any(q, MONEY_WORDS) & contains_any(q, PROCESS_WORDS)
    )
    pair = lambda a, b: F.struct(F.lit(a).alias("query_type"), F.lit(b).alias("classifier_reason"))
    return (
        F.when(multi, pair("factual", "student_multi_aspect_fact"))
        .when(matches_any(q, REASONING, "(?U)"), pair("reasoning", "reasoning_marker"))
        .when(matches_any(q, FACTUAL, "(?U)"), pair("factual", "factual_marker"))
        .when(F.size(content_tokens(q)) <= 6, pair("factual", "short_fact_like_query"))
        .otherwise(pair("reasoning", "default_reasoning"))
    )


def profile(query: Column, given: dict[str, Column] | None = None) -> Column:
    """``struct(education_level, role, intent, academic_interest)``.

    Given values win; the others come from the ordered needle tables over the query
    and the given values.
    """
    given = {name: text_or_empty((given or {}).get(name, F.lit(""))) for name, _ in PROFILE_FIELDS}
    hay = F.lower(F.concat_ws(" ", query, *given.values()))
    fields = []
    for name, rules in PROFILE_FIELDS:
        found = first_label(hay, rules)
        if name == "academic_interest":
            found = F.when((found == "") & hay.rlike(r"(?U)\bnetwork\s+engineering\b"), "engineering").otherwise(found)
        fields.append(F.when(given[name] != "", given[name]).otherwise(found).alias(name))
    return F.struct(*fields)


def is_leadership(query: Column) -> Column:
    return contains_any(normal(query), LEADER_HINTS)


def is_person_lookup(query: Column) -> Column:
    q = normal(query)
    return (q != "") & (q.rlike(r"(?U)\bwho\b") | contains_any(q, LEADER_HINTS))


def expanded_query(query: Column) -> Column:
    """``struct(original, effective, expansions)``: synonyms for known short forms."""
    original = collapse_space(text_or_empty(query))
    low = F.lower(original)
    person = is_person_lookup(query)
    networking = (
        low.rlike(r"(?U)\bnetworking\b") & ~low.contains("network engineering")
        & (person | low.rlike(r"(?U)\b(?:program|major|degree|ms|m\.s)\b"))
    )
    home = is_leadership(query) & low.rlike(r"(?U)\bsmu\b") & ~low.contains("lyle")
    base = F.when(
        networking, F.regexp_replace(original, r"(?iU)\bnetworking\b", "network engineering")
    ).otherwise(original)
    none = F.array().cast("array<string>")
    expansions = F.concat(
        F.when(networking, F.array(*[F.lit(v) for v in NETWORK_EXPANSIONS])).otherwise(none),
        F.when(home, F.array(F.lit(HOME_SCHOOL))).otherwise(none),
    )
    extra = F.array_join(F.filter(expansions, lambda v: ~low.contains(v)), " ")
    effective = F.when(extra != "", F.concat(base, F.lit(" "), extra)).otherwise(base)
    return F.struct(original.alias("original"), effective.alias("effective"), expansions.alias("expansions"))


def wanted_schools(query: Column) -> Column:
    """Folders of the schools the query names."""
    low = F.lower(text_or_empty(query))
    return F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(s)) for s, words in SCHOOL_PAGES]))


def school_folders(path: Column) -> Column:
    """School folders inside a page path."""
    return F.array_compact(F.array(*[F.when(path.contains(s), F.lit(s)) for s, _ in SCHOOL_PAGES]))


def wants_graduate(query: Column) -> Column:
    return contains_any(F.lower(text_or_empty(query)), GRADUATE_WORDS)


def wants_several_aspects(query: Column) -> Column:
    low = F.lower(text_or_empty(query))
    groups = (COURSE_WORDS, MONEY_WORDS, ADMISSION_WORDS)
    return sum((contains_any(low, g).cast("int") for g in groups), F.lit(0)) >= 2


def route_list(preferred: Column, fallback: Column | None = None) -> Column:
    """Slugs of a routing list, or of its frontmatter twin when it is empty."""
    slugs = lambda a: F.transform(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda v: v != ""), slug)
    own = slugs(preferred)
    return own if fallback is None else F.when(F.size(own) > 0, own).otherwise(slugs(fallback))


# Routing bonuses in the order their reasons are listed.
def route_parts(p: Column, corpus: Column, routing: Column, tags: Column) -> list[tuple[Column, float, str]]:
    """``(applies, bonus, reason)`` of each routing rule.

    ``p`` is a profile struct; ``routing`` a struct of slug lists ``audiences``, ``roles``,
    ``intents`` and ``academic_interests``.
    """
    has = lambda value, options: (value != "") & F.array_contains(options, slug(value))
    audiences, intents = routing["audiences"], routing["intents"]
    young = p["education_level"].isin("early learner", "secondary student")
    grown = F.arrays_overlap(audiences, F.array(F.lit("graduate"), F.lit("researcher")))
    off_intent = (
        (p["intent"] != "") & (F.size(intents) > 0) & ~has(p["intent"], intents)
        & ~F.array_contains(intents, "explore")
    )
    tag_slugs = F.transform(tags, slug)
    return [
        (corpus == "wiki", 0.15, "routed_wiki_candidate"),
        (has(p["intent"], intents), 0.9, "intent_route_match"),
        (has(p["role"], F.concat(routing["roles"], audiences)), 0.6, "profile_role_match"),
        (has(p["education_level"], audiences), 0.5, "education_level_match"),
        (has(p["academic_interest"], F.concat(routing["academic_interests"], tag_slugs)), 0.5, "academic_interest_match"),
        ((young & grown) | off_intent, -1.4, "profile_scope_penalty"),
    ]
