"""What a detector is told: levels, patterns, checks, limits and the response; and presets of it."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from enum import Enum

from grainmill.functions.levels import SEVERITY_LEVELS, SecurityLevel
from grainmill.operators.mitigate import Response
from grainmill.operators.patterns import Matcher
from grainmill.operators.preprocess import Preprocessing


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass(frozen=True)
class Patterns:
    categories: tuple[str, ...] | None = None
    custom: tuple[str, ...] = ()
    case_sensitive: bool = False
    max_patterns: int = 3000


@dataclass(frozen=True)
class Keywords:
    enabled: bool = False
    model_name: str | None = None
    similarity_threshold: float = 0.8
    max_context_length: int = 512


@dataclass(frozen=True)
class Resources:
    """Only the time limit means anything to a caller; the rest is kept for policies that carry it."""

    max_concurrent_analyses: int = 100
    analysis_timeout_s: float = 10.0
    max_memory_mb: int = 512
    pattern_cache_size: int = 1000


@dataclass(frozen=True)
class DetectorConfig:
    security_level: SecurityLevel = SecurityLevel()
    severity_level: str | None = None
    patterns: Patterns = Patterns()
    keywords: Keywords = Keywords()
    preprocessing: Preprocessing = Preprocessing()
    response: Response = Response()
    resources: Resources = Resources()
    metrics: bool = True

    @property
    def level(self) -> SecurityLevel:
        """The level in force: an older severity name, where one was given by hand, wins."""
        return SecurityLevel(SEVERITY_LEVELS[self.severity_level]) if self.severity_level else self.security_level

    def matcher(self) -> Matcher:
        p = self.patterns
        return Matcher(self.level, p.categories, p.custom, p.case_sensitive, p.max_patterns)

    def validate(self) -> DetectorConfig:
        checks = (
            (self.severity_level is None or self.severity_level in SEVERITY_LEVELS, "unknown severity level"),
            (self.resources.max_concurrent_analyses > 0, "max_concurrent_analyses must be greater than 0"),
            (self.resources.analysis_timeout_s > 0, "analysis_timeout must be greater than 0"),
            (math.isfinite(self.keywords.similarity_threshold) and 0 < self.keywords.similarity_threshold <= 1, "similarity_threshold must be greater than 0 and at most 1"),
            (self.keywords.max_context_length > 0, "max_context_length must be greater than 0"),
            (self.preprocessing.max_length > 0, "max_length must be greater than 0"),
        )
        for met, message in checks:
            if not met:
                raise ConfigError(message)
        try:
            self.matcher()
        except ValueError as e:
            raise ConfigError(str(e)) from e
        return self


class ConfigBuilder:
    """Setters that return the builder; ``build`` does not validate."""

    def __init__(self) -> None:
        self._c = DetectorConfig()

    def _with(self, **changes) -> ConfigBuilder:
        self._c = replace(self._c, **changes)
        return self

    def with_security_level(self, level: int) -> ConfigBuilder:
        return self._with(security_level=SecurityLevel(level), severity_level=None)

    def with_severity_level(self, name: str) -> ConfigBuilder:
        return self._with(severity_level=name)

    def with_response(self, kind: str, message: str = "") -> ConfigBuilder:
        return self._with(response=Response(kind, message))

    def with_patterns(self, patterns: Patterns) -> ConfigBuilder:
        return self._with(patterns=patterns)

    def with_custom_patterns(self, *patterns: str) -> ConfigBuilder:
        return self._with(patterns=replace(self._c.patterns, custom=tuple(patterns)))

    def with_keywords(self, keywords: Keywords) -> ConfigBuilder:
        return self._with(keywords=keywords)

    def with_keyword_checks(self, enabled: bool = True) -> ConfigBuilder:
        return self._with(keywords=replace(self._c.keywords, enabled=enabled))

    def with_preprocessing(self, preprocessing: Preprocessing) -> ConfigBuilder:
        return self._with(preprocessing=preprocessing)

    def with_resources(self, resources: Resources) -> ConfigBuilder:
        return self._with(resources=resources)

    def with_timeout(self, seconds: float) -> ConfigBuilder:
        return self._with(resources=replace(self._c.resources, analysis_timeout_s=seconds))

    def with_metrics(self, enabled: bool) -> ConfigBuilder:
        return self._with(metrics=enabled)

    def build(self) -> DetectorConfig:
        return self._c


class Preset(Enum):
    CHAT_BOT = "ChatBot"
    CODE_ASSISTANT = "CodeAssistant"
    CUSTOMER_SERVICE = "CustomerService"
    EDUCATIONAL = "Educational"
    FINANCIAL = "Financial"
    HEALTHCARE = "Healthcare"
    DEVELOPMENT = "Development"
    CUSTOM = "Custom"

    @property
    def description(self) -> str:
        return _PRESETS[self].description

    def metadata(self) -> dict[str, str]:
        """What the preset is meant for, for a host to read."""
        p = _PRESETS[self]
        return {"deployment_domain": p.domain, "preset_type": p.domain, "optimize_for": p.optimize_for}

    def config(self) -> DetectorConfig:
        p = _PRESETS[self]
        return DetectorConfig(
            security_level=SecurityLevel(p.level), response=Response(p.response), patterns=Patterns(p.categories, p.custom, False, p.max_patterns), keywords=Keywords(*p.keywords),
            preprocessing=Preprocessing(p.decode, p.decode, p.max_bytes, p.preserve), resources=Resources(*p.resources),
        )


@dataclass(frozen=True)
class _Preset:
    description: str
    level: int
    response: str
    max_bytes: int
    resources: tuple[int, float, int, int]
    domain: str
    optimize_for: str
    custom: tuple[str, ...] = ()
    categories: tuple[str, ...] | None = None
    max_patterns: int = 3000
    keywords: tuple[bool, str | None, float, int] = (False, None, 0.8, 512)
    decode: bool = True
    preserve: bool = True


# The presets. Resources are analyses at once, seconds, megabytes and patterns kept.
_PRESETS = {
    Preset.CHAT_BOT: _Preset(
        "Level 5 with a sanitize response strategy", 5, "sanitize", 5000, (200, 5, 256, 1000), "chatbot", "user_experience",
        (r"act\s+as\s+(?:dan|jailbreak|unrestricted)", r"pretend\s+you're\s+not\s+an?\s+ai"), None, 2000, preserve=False,
    ),
    Preset.CODE_ASSISTANT: _Preset(
        "Level 4 with a warning response strategy", 4, "warn", 20_000, (50, 15, 512, 500), "code_assistant", "technical_accuracy",
        (r"execute\s+(?:system|shell|command)", r"run\s+(?:malicious|harmful)\s+code"),
        ("instruction_override", "jailbreak", "encoding_bypass", "data_extraction"), 1500, (False, None, 0.85, 1024),
    ),
    Preset.CUSTOMER_SERVICE: _Preset(
        "Level 6 with a block response strategy", 6, "block", 3000, (100, 3, 256, 800), "customer_service", "professionalism",
        (r"customer\s+service\s+override", r"escalate\s+to\s+manager\s+mode"), None, 2500, (False, None, 0.75, 512), preserve=False,
    ),
    Preset.EDUCATIONAL: _Preset(
        "Level 3 with a sanitize response strategy", 3, "sanitize", 10_000, (150, 8, 384, 600), "educational", "learning_support",
        (r"cheat\s+on\s+(?:exam|test|homework)", r"give\s+me\s+the\s+answers?"), ("instruction_override", "jailbreak", "data_extraction"), 1000,
    ),
    Preset.FINANCIAL: _Preset(
        "Level 9 with a block response strategy", 9, "block", 5000, (25, 30, 1024, 2000), "financial", "maximum_security",
        (r"bypass\s+(?:audit|compliance|regulation)", r"ignore\s+(?:privacy|security)\s+policies", r"transfer\s+(?:funds|money)\s+to", r"account\s+(?:number|details|credentials)"),
        None, 5000, (True, None, 0.70, 1024),
    ),
    Preset.HEALTHCARE: _Preset(
        "Level 8 with a block response strategy", 8, "block", 8000, (50, 20, 768, 1500), "healthcare", "privacy_protection",
        (r"patient\s+(?:records?|data|information)", r"medical\s+(?:records?|history|data)", r"hipaa\s+(?:bypass|violation|ignore)", r"ssn|social\s+security\s+number", r"(?:dob|date\s+of\s+birth)"),
        None, 4000, (True, None, 0.75, 1024),
    ),
    Preset.DEVELOPMENT: _Preset(
        "Level 2 with an allow response strategy", 2, "allow", 50_000, (10, 2, 128, 200), "development", "developer_productivity",
        (r"rm\s+-rf\s+/", r"delete\s+all\s+files"), ("instruction_override", "jailbreak"), 500, (False, None, 0.9, 256), decode=False,
    ),
    Preset.CUSTOM: _Preset("User-defined custom configuration", 5, "block", 10_000, (100, 10, 512, 1000), "custom", "user_defined", preserve=False),
}

# Words of a use case that recommend a preset, in order.
_USES = (
    (Preset.CHAT_BOT, ("chat", "conversation")),
    (Preset.CODE_ASSISTANT, ("code", "programming", "development")),
    (Preset.CUSTOMER_SERVICE, ("customer", "support", "service")),
    (Preset.EDUCATIONAL, ("education", "learning", "school")),
    (Preset.FINANCIAL, ("financial", "banking", "payment")),
    (Preset.HEALTHCARE, ("health", "medical", "hipaa")),
    (Preset.DEVELOPMENT, ("dev", "test", "debug")),
)


def all_presets() -> list[tuple[Preset, str]]:
    return [(p, p.description) for p in Preset]


def recommend(use_case: str, security: str, performance: str) -> list[Preset]:
    """Presets by keywords, then by the two priorities; a chat bot and a blank one if nothing fits."""
    said = lambda text, words: any(w in text.lower() for w in words)
    out = [p for p, ws in _USES if said(use_case, ws)]
    more: tuple[Preset, ...] = ()
    if said(security, ("high", "maximum", "strict")):
        more = (Preset.FINANCIAL, Preset.HEALTHCARE)
    elif said(security, ("low", "minimal")):
        more = (Preset.DEVELOPMENT,)
    out += [p for p in more if p not in out]
    if said(performance, ("high", "fast", "speed")):
        out = [p for p in out if p not in (Preset.FINANCIAL, Preset.HEALTHCARE)]
        out += [p for p in (Preset.DEVELOPMENT, Preset.CHAT_BOT) if p not in out]
    return out or [Preset.CHAT_BOT, Preset.CUSTOM]
