"""Plain-language requests to structured intents, tasks and ranking profiles.

One projection per step; lists of words are parameters bundled in
``RequestLexicon`` so that other languages use the same code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.columns import bind, let
from ..functions.match import Rules, compact, constant, contains_any, first_label, labels, longest_label
from ..functions.text import as_col, squeeze, strip

ListRules = Sequence[tuple[Sequence[str], Sequence[str]]]


@dataclass
class RequestLexicon:
    """All word lists a request is read with; the defaults are the Chinese ones."""

    age_patterns: Sequence[str] = field(default_factory=lambda: L.AGE_PATTERNS)
    grades: Sequence[tuple[str, int]] = field(default_factory=lambda: L.GRADE_NAMES)
    age_stages: Sequence[tuple[int, int, str]] = field(default_factory=lambda: L.AGE_STAGES)
    stages: Rules = field(default_factory=lambda: L.STAGE_RULES)
    bridge_profile: str = L.BRIDGE_PROFILE
    preschool: str = L.PRESCHOOL
    profiles: Rules = field(default_factory=lambda: L.PROFILE_RULES)
    domains: Rules = field(default_factory=lambda: L.DOMAIN_RULES)
    subjects: Sequence[str] = field(default_factory=lambda: L.SUBJECTS)
    topics: Rules = field(default_factory=lambda: L.TOPIC_RULES)
    domain_topics: Sequence[tuple[str, Rules, str]] = field(default_factory=lambda: L.DOMAIN_TOPICS)
    subtopics: ListRules = field(default_factory=lambda: L.SUBTOPIC_RULES)
    early_types: ListRules = field(default_factory=lambda: L.EARLY_TYPE_RULES)
    types: Rules = field(default_factory=lambda: L.REQUEST_TYPE_RULES)
    late_types: ListRules = field(default_factory=lambda: L.LATE_TYPE_RULES)
    goals_by_type: Sequence[tuple[str, Sequence[str]]] = field(default_factory=lambda: L.GOAL_BY_TYPE)
    goals: Rules = field(default_factory=lambda: L.GOAL_RULES)
    no_goal: str = L.NO_GOAL
    difficulties: Rules = field(default_factory=lambda: L.DIFFICULTY_RULES)
    young_difficulty: str = L.YOUNG_DIFFICULTY
    formats: Rules = field(default_factory=lambda: L.REQUEST_FORMAT_RULES)
    sources: Rules = field(default_factory=lambda: L.SOURCE_RULES)
    versions: Sequence[str] = field(default_factory=lambda: L.VERSIONS)
    volumes: Sequence[str] = field(default_factory=lambda: L.VOLUMES)
    constraints: Rules = field(default_factory=lambda: L.CONSTRAINT_RULES)
    full_scope: Sequence[str] = field(default_factory=lambda: L.FULL_SCOPE_TERMS)
    coverage: Rules = field(default_factory=lambda: L.COVERAGE_RULES)
    local_terms: Sequence[str] = field(default_factory=lambda: L.LOCAL_TERMS)
    local_task_terms: Sequence[str] = field(default_factory=lambda: L.LOCAL_TASK_TERMS)
    named_terms: Sequence[str] = field(default_factory=lambda: L.NAMED_RESOURCE_TERMS)
    broad_terms: Sequence[str] = field(default_factory=lambda: L.BROAD_TERMS)
    textbook_type: str = L.TEXTBOOK_TYPE
    wide_topics: Sequence[str] = field(default_factory=lambda: L.WIDE_TOPICS)
    vague_topics: Sequence[str] = field(default_factory=lambda: L.VAGUE_TOPICS)
    narrowing_terms: Sequence[str] = field(default_factory=lambda: L.NARROWING_TERMS)
    download_terms: Sequence[str] = field(default_factory=lambda: L.DOWNLOAD_TERMS)
    print_terms: Sequence[str] = field(default_factory=lambda: L.PRINT_TERMS)
    print_word: str = "可打印"
    print_format: str = "PDF"
    official_source: str = "官方"
    local_suffix: str = "本地资料"


def normalize_query(query: Column | str) -> Column:
    """Blanks squeezed, then only CJK, Latin letters, digits and common marks."""
    kept = F.regexp_replace(squeeze(query), r"""[^一-龥a-zA-Z0-9，。、？！；："'（）《》\s]""", "")
    return strip(kept)


def _list_rules(text: Column, rules: ListRules, every: bool = False) -> list[Column]:
    out = []
    for values, terms in rules:
        if every:
            test = F.forall(constant(terms), lambda t: F.contains(text, t))
        else:
            test = contains_any(text, terms)
        out += [F.when(test, F.lit(v)) for v in values]
    return out


def _age(text: Column, patterns: Sequence[str]) -> Column:
    found = []
    for pattern in patterns:
        value = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
        found.append(bind(value, lambda v: F.when(v.between(3, 12), v)))
    return F.coalesce(*found, F.lit(None).cast("int")) if found else F.lit(None).cast("int")


def parse_intents(requests: DataFrame, lex: RequestLexicon | None = None, query: str = "query") -> DataFrame:
    """Adds the slots of every request, its type, gaps, questions and status."""
    lex = lex or RequestLexicon()
    text = F.col("_q")
    base = let(requests, {"_q": strip(query)})
    grade = F
    for name, number in lex.grades:
        grade = grade.when(F.contains(text, F.lit(name)), number)
    grade = grade.otherwise(F.lit(None).cast("int")) if lex.grades else F.lit(None).cast("int")
    base = let(
        base,
        {
            "normalized_query": normalize_query(text),
            "learner_age": _age(text, lex.age_patterns),
            "grade": grade,
            "learner_profile": first_label(text, lex.profiles),
            "learning_domain": first_label(text, lex.domains),
        },
    )
    age = F.col("learner_age")
    by_age = F
    for low, high, name in lex.age_stages:
        by_age = by_age.when(age.between(low, high), name)
    by_age = by_age.otherwise(F.lit(None)) if lex.age_stages else F.lit(None).cast("string")
    stage = F.coalesce(
        by_age,
        F.when(F.col("learner_profile") == lex.bridge_profile, lex.preschool),
        longest_label(text, lex.stages),
    )
    named = compact(
        _list_rules(text, lex.early_types) + [F.when(contains_any(text, t), F.lit(n)) for n, t in lex.types]
    )
    guessed = compact(_list_rules(text, lex.late_types))
    domain_topic = F
    for domain, rules, default in lex.domain_topics:
        domain_topic = domain_topic.when(
            F.col("learning_domain") == domain, F.coalesce(first_label(text, rules), F.lit(default))
        )
    domain_topic = domain_topic.otherwise(F.lit(None)) if lex.domain_topics else F.lit(None).cast("string")
    staged = let(
        base,
        {
            "stage": stage,
            "subject": F.coalesce(first_label(text, [(s, [s]) for s in lex.subjects]), F.col("learning_domain")),
            "core_topic": F.coalesce(longest_label(text, lex.topics), domain_topic),
            "subtopics": compact(_list_rules(text, lex.subtopics, every=True)),
            "_named": named,
        },
    )
    staged = let(
        staged, {"resource_types": F.array_distinct(F.when(F.size("_named") > 0, F.col("_named")).otherwise(guessed))}
    )
    types = F.col("resource_types")
    goal = F
    for name, kinds in lex.goals_by_type:
        goal = goal.when(F.arrays_overlap(types, F.array(*[F.lit(k) for k in kinds])), name)
    goal = goal.otherwise(F.coalesce(first_label(text, lex.goals), F.lit(lex.no_goal)))
    url = F.regexp_like(text, F.lit("https?://"))
    scope = F.when(url, "exact").when(contains_any(text, lex.full_scope), "full_coverage").otherwise("candidate_set")
    filled = let(
        staged,
        {
            "resource_goal": goal,
            "difficulty": F.coalesce(
                first_label(text, lex.difficulties), F.when(age <= 6, F.lit(lex.young_difficulty))
            ),
            "format_preferences": labels(text, lex.formats),
            "source_preferences": labels(text, lex.sources),
            "version": first_label(text, [(v, [v]) for v in lex.versions]),
            "volume": first_label(text, [(v, [v]) for v in lex.volumes]),
            "request_scope": scope,
            "coverage_targets": labels(text, lex.coverage),
            "constraints": labels(text, lex.constraints),
        },
    )
    precise = (
        F.array_contains(types, lex.textbook_type)
        & F.col("version").isNotNull()
        & F.col("grade").isNotNull()
        & F.col("subject").isNotNull()
        & F.col("volume").isNotNull()
    )
    kind = (
        F.when(contains_any(text, lex.local_terms), "local_lookup")
        .when(url | contains_any(text, lex.named_terms) | precise, "exact_resource")
        .when(contains_any(text, lex.broad_terms), "broad_exploration")
        .otherwise("topic_resource")
    )
    return missing_slots(filled.withColumn("intent_type", kind), lex).drop("_q", "_named")


def missing_slots(intents: DataFrame, lex: RequestLexicon | None = None, query: str = "_q") -> DataFrame:
    """Adds the missing slots, at most three questions, the status and the confidence."""
    lex = lex or RequestLexicon()
    text = F.col(query)
    no_age = F.col("learner_age").isNull() & F.col("grade").isNull()
    topic, domain = F.col("core_topic"), F.col("learning_domain")
    no_topic = topic.isNull() & domain.isNull()
    scoped = ~no_age & domain.isNotNull() & (F.size("resource_types") > 0)
    wide = (
        F.coalesce(topic.isin(list(lex.wide_topics)), F.lit(False)) & ~scoped & ~contains_any(text, lex.narrowing_terms)
    )
    wants_files = contains_any(text, lex.download_terms)
    no_type = (F.size("resource_types") == 0) & (F.col("resource_goal") == lex.no_goal) & wants_files
    vague = (
        (F.col("request_scope") == "full_coverage")
        & wants_files
        & (topic.isNull() | topic.isin(list(lex.vague_topics)))
    )
    q = {k: F.lit(v) for k, v in L.QUESTIONS.items()}
    listed = compact(
        [
            F.when(no_age & ~vague, F.lit("learner_age_or_grade")),
            F.when(no_topic | wide, F.lit("core_topic")),
            F.when(no_type, F.lit("resource_goal_or_type")),
            F.when(vague, F.lit("core_topic")),
            F.when(vague, F.lit("resource_types")),
        ]
    )
    asked = F.when(vague, F.array(q["vague_topic"], q["type"])).otherwise(
        F.slice(
            compact(
                [
                    F.when(no_age, q["age"]),
                    F.when(no_topic, q["topic"]),
                    F.when(wide, q["narrow"]),
                    F.when(no_type, q["type"]),
                ]
            ),
            1,
            3,
        )
    )
    gaps = let(intents, {"missing_slots": listed, "_asked": asked})
    ready = F.size("missing_slots") == 0
    return let(
        gaps,
        {
            "clarifying_questions": F.when(ready, F.array().cast("array<string>")).otherwise(F.col("_asked")),
            "status": F.when(ready, "ready").otherwise("needs_clarification"),
            "confidence": F.when(ready, 0.85).otherwise(0.0),
        },
    ).drop("_asked")


def base_query() -> Column:
    """Age, grade, topic and the first two types as search words."""
    return F.concat_ws(
        " ",
        F.concat(F.col("learner_age").cast("string"), F.lit("岁")),
        F.concat(F.col("grade").cast("string"), F.lit("年级")),
        F.coalesce("core_topic", "learning_domain"),
        F.when(F.size("resource_types") > 0, F.array_join(F.slice("resource_types", 1, 2), " ")),
    )


def plan_tasks(intents: DataFrame, lex: RequestLexicon | None = None, query: str = "query") -> DataFrame:
    """No row for an unclear request, else an optional local task and a web task."""
    lex = lex or RequestLexicon()
    text = F.col(query)
    local = contains_any(text, lex.local_task_terms) | F.exists(
        "source_preferences", lambda s: contains_any(s, lex.local_task_terms)
    )
    prints = contains_any(text, lex.print_terms) | F.exists("constraints", lambda c: contains_any(c, lex.print_terms))
    based = let(
        intents.where(F.col("status") == "ready"), {"_base": base_query(), "_local": local, "_print": prints}
    )
    base = F.col("_base")
    web_query = F.concat(
        base,
        F.when(F.col("_print"), F.lit(f" {lex.print_word}")).otherwise(F.lit("")),
        F.when(F.array_contains("format_preferences", lex.print_format), F.lit(f" {lex.print_format}")).otherwise(F.lit("")),
    )

    def task(task_id: Column, kind: str, skill: str, priority: Column, words: Column, printable: Column, policy: str) -> Column:
        return F.struct(
            task_id.alias("task_id"),
            F.lit(kind).alias("task_type"),
            F.lit(skill).alias("target_skill"),
            F.lit("search").alias("action"),
            priority.cast("int").alias("priority"),
            words.alias("query"),
            printable.alias("printable"),
            F.lit(policy).alias("download_policy"),
        )

    first = F.when(
        F.col("_local"),
        task(
            F.lit("task_000"), "local_search", L.LOCAL_SOURCE, F.lit(1),
            F.concat(base, F.lit(f" {lex.local_suffix}")), F.lit(False), "never",
        ),
    )
    after = F.col("_local").cast("int")
    second = task(
        F.when(F.col("_local"), F.lit("task_002")).otherwise(F.lit("task_001")),
        "source_search", L.WEB_SOURCE, after + 1, web_query, F.col("_print"), "after_user_selection",
    )
    exploded = based.withColumn("task", F.explode(F.array_compact(F.array(first, second))))
    return exploded.withColumn("age_fit_required", F.col("learner_age").isNotNull() | F.col("grade").isNotNull()).drop(
        "_base", "_local", "_print"
    )


def ranking_profile(intents: DataFrame, lex: RequestLexicon | None = None) -> DataFrame:
    """Adds primary goal, must match, prefer, avoid and weights."""
    lex = lex or RequestLexicon()
    goal = F.col("resource_goal")
    primary = F
    for name, text in L.PRIMARY_GOALS.items():
        primary = primary.when(goal == name, text)
    prints = F.array_contains("format_preferences", lex.print_format) | F.exists(
        "constraints", lambda c: contains_any(c, lex.print_terms)
    )
    official = F.array_contains("source_preferences", lex.official_source)

    def weight(name: str) -> Column:
        out = F
        for special, table in L.GOAL_WEIGHTS.items():
            if name in table:
                out = out.when(goal == special, F.lit(table[name]))
        return (F.lit(L.PROFILE_WEIGHTS[name]) if out is F else out.otherwise(F.lit(L.PROFILE_WEIGHTS[name]))).alias(name)

    return intents.withColumns(
        {
            "primary_goal": primary.otherwise(L.DEFAULT_PRIMARY_GOAL),
            "must_match": compact(
                [
                    F.when(F.col("learner_age").isNotNull(), F.lit("learner_age")),
                    F.when(F.col("core_topic").isNotNull(), F.lit("core_topic")),
                ]
            ),
            "prefer": compact(
                [
                    F.when(prints, F.lit(lex.print_format)),
                    F.when(prints, F.lit(lex.print_word)),
                    F.when(official, F.lit(lex.official_source)),
                ]
            ),
            "avoid": F.array(*[F.lit(a) for a in L.AVOID]),
            "weights": F.struct(*[weight(n) for n in L.PROFILE_WEIGHTS]),
        }
    )


def intent_filters(tasks: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Task filters (struct ``filters``), gaps filled from the request's own slots."""
    names = tasks.schema["filters"].dataType.names
    cols = []
    for slot in slots:
        own = F.col(slot) if slot in tasks.columns else F.lit(None)
        cols.append((F.coalesce(F.col(f"filters.{slot}"), own) if slot in names else own).alias(slot))
    kept = [c for c in tasks.columns if c not in slots and c != "filters"]
    return tasks.select(*kept, *cols)


def request_terms(intents: DataFrame, query: str = "query") -> Column:
    """Words a request is compared to routes with."""
    blob = F.concat_ws(
        " ", as_col(query), "learning_domain", "subject", "core_topic", F.array_join("resource_types", " ")
    )
    return F.array_distinct(F.array_remove(F.split(F.regexp_replace(blob, "[/，,]", " "), r"\s+"), ""))


def wants_textbook(query: str = "query", terms: Sequence[str] = L.TEXTBOOK_WORDS) -> Column:
    blob = F.concat_ws(" ", F.array_join("resource_types", " "), as_col(query))
    return bind(blob, lambda b: contains_any(b, terms))

