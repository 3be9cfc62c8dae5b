"""Settings: values as a caller gives them made whole (coercion, clamps), defaults, and rows added to older tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Words that stand for a switch's two positions (fixed values).
SWITCH = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}


def fitted(raw: Any, default):
    """What a caller sent as a value of the default's type.

    Texts and lists of texts are trimmed, blank ones left out; numbers also switch; what cannot be read, and a blank
    number, is the default.
    """
    text = str(raw).strip() if raw is not None else ""
    match default:
        case list():
            return [t for t in (fitted(x, "") for x in raw) if t] if isinstance(raw, list) else default
        case bool():
            return raw != 0 if isinstance(raw, (int, float)) else SWITCH.get(text.lower(), default)
        case str():
            return text
    try:
        return type(default)(raw) if text else default
    except (TypeError, ValueError, OverflowError):
        return default


def between(value, low, high):
    return max(low, min(high, value))


@dataclass(frozen=True)
class IndexSettings:
    exclude_dirs: tuple[str, ...] = (".git", "node_modules", "target", "Library", "Caches", "Application Support")
    exclude_exts: tuple[str, ...] = ()
    max_file_size_mb: int = 50
    semantic_search_enabled: bool = True
    semantic_weight: float = 0.25
    semantic_threshold: float = 0.2
    title_weight: float = 1.0
    filename_weight: float = 1.0
    preference_weight: float = 1.0
    prefer_favorites_enabled: bool = True
    prefer_recent_enabled: bool = True
    prefer_history_enabled: bool = True

    def clamped(self) -> IndexSettings:
        return replace(self, max_file_size_mb=max(0, self.max_file_size_mb), **{f: between(getattr(self, f), 0.0, 1.0) for f in ("semantic_weight", "semantic_threshold")}, **{f: between(getattr(self, f), 0.0, 3.0) for f in ("title_weight", "filename_weight", "preference_weight")})


@dataclass(frozen=True)
class AnswerSettings:
    enabled: bool = False
    provider: str = "ollama"
    base_url: str = "http://127.0.0.1:11434/v1"
    api_key: str = ""
    model: str = ""
    temperature: float = 0.2
    max_output_tokens: int = 600
    context_chunk_limit: int = 8
    context_token_budget: int = 6000
    min_evidence_count: int = 1
    min_retrieval_score: float = 0.0
    intent_synonym_rules_json: str = ""

    def clamped(self) -> AnswerSettings:
        text = {f: getattr(self, f).strip() for f in ("provider", "base_url", "model", "intent_synonym_rules_json")}
        least = {f: max(1, getattr(self, f)) for f in ("max_output_tokens", "context_chunk_limit", "context_token_budget", "min_evidence_count")}
        return replace(self, temperature=between(self.temperature, 0.0, 2.0), **text, **least)

    @property
    def answer_tokens(self) -> int:
        """What an answer may take: 1200 at least, so that none is cut short."""
        return max(1200, self.max_output_tokens)


@dataclass(frozen=True)
class ProxySettings:
    enabled: bool = False
    proxy_url: str = ""

    def clamped(self) -> ProxySettings:
        return replace(self, proxy_url=self.proxy_url.strip())


@dataclass(frozen=True)
class Request:
    """A question as a caller sends it; ``options`` go before the top level, what is unusable is the default."""

    question: str
    scope_paths: list[str] = field(default_factory=list)
    recent_questions: list[str] = field(default_factory=list)
    session_context: str = ""
    settings: AnswerSettings = field(default_factory=AnswerSettings)

    @classmethod
    def of(cls, data: dict) -> Request:
        options = data.get("options") if isinstance(data.get("options"), dict) else {}
        get = lambda name: options[name] if name in options else data.get(name)
        default = AnswerSettings()
        sent = {f.name: fitted(get(f.name), getattr(default, f.name)) for f in fields(default)}
        # A blank text is no choice.
        settings = AnswerSettings(**{name: value if value != "" else getattr(default, name) for name, value in sent.items()})
        return cls(fitted(get("question"), ""), fitted(get("scope_paths"), []), fitted(get("recent_questions"), []), fitted(get("session_context"), ""), settings.clamped())


KINDS = {"index": IndexSettings, "answers": AnswerSettings, "proxy": ProxySettings}


def save(spark: SparkSession, folder: str, settings, now: int) -> None:
    """One row, trimmed and clamped, with the time it was saved."""
    import json

    name = next(k for k, c in KINDS.items() if isinstance(settings, c))
    row = json.dumps(asdict(settings.clamped()) | {"updated_at": now}, ensure_ascii=False)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings-{name}")


def load(spark: SparkSession, folder: str, name: str):
    """Settings and when they were saved (0: never); the defaults where there are none."""
    import json

    from pyspark.errors import AnalysisException

    kind = KINDS[name]
    try:
        rows = spark.read.text(f"{folder}/settings-{name}").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    if not rows:
        return kind(), 0
    data = json.loads("".join(r[0] for r in rows))
    known = {f.name: tuple(data[f.name]) if isinstance(data[f.name], list) else data[f.name] for f in fields(kind) if f.name in data}
    return kind(**known).clamped(), data.get("updated_at", 0)


def clamp(value, low, high):
    """The same for columns."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def migrated(rows: DataFrame, schema: dict[str, tuple[str, Any]]) -> DataFrame:
    """rows with the columns that a newer table has: name -> (type, default); nothing is taken away."""
    have = set(rows.columns)
    return rows.select(*rows.columns, *[F.lit(default).cast(kind).alias(name) for name, (kind, default) in schema.items() if name not in have])


def seeded(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """rows, or the default rows where there are none."""
    any_row = rows.limit(1).agg(F.count("*").alias("n"))
    return rows.unionByName(defaults.crossJoin(F.broadcast(any_row)).filter("n = 0").drop("n"))  # one row
