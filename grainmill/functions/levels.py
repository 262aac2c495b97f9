"""What a security level (0 to 10) sets, and the weights of threat kinds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32
RISKS = ("None", "Low", "Medium", "High", "Critical")

# Weights, texts and first levels that results depend on.
SEVERITY = {
    "InstructionOverride": 0.9, "RolePlaying": 0.7, "ContextConfusion": 0.8, "EncodingBypass": 0.6, "Jailbreak": 0.95,
    "SocialEngineering": 0.5, "DataExtraction": 0.85, "SystemPromptLeak": 0.9, "CodeInjection": 0.95, "Custom": 0.5,
}
DESCRIPTIONS = {
    "InstructionOverride": "Direct instruction override attempt",
    "RolePlaying": "Role playing attack",
    "ContextConfusion": "Context confusion attack",
    "EncodingBypass": "Encoding bypass attempt",
    "Jailbreak": "Jailbreak pattern",
    "SocialEngineering": "Social engineering attempt",
    "DataExtraction": "Data extraction attempt",
    "SystemPromptLeak": "System prompt leak attempt",
    "CodeInjection": "Code injection attempt",
}
LEVEL_TEXTS = (
    "Highest thresholds; no default built-in pattern categories",
    "Base instruction-override and jailbreak categories",
    "Base categories with lower decision thresholds",
    "Adds social-engineering categories",
    "Social-engineering categories with lower thresholds",
    "Adds encoding and context categories",
    "Encoding and context categories with lower thresholds",
    "Adds advanced pattern categories",
    "Advanced categories with lower thresholds",
    "Adds high-sensitivity pattern categories",
    "All built-in categories with the lowest thresholds",
)
#: category: (threat kind, base confidence or None where the level sets it, first level)
CATEGORIES: dict[str, tuple[str, float | None, int]] = {
    "instruction_override": ("InstructionOverride", 0.95, 1),
    "jailbreak": ("Jailbreak", 0.98, 1),
    "social_engineering": ("SocialEngineering", 0.7, 3),
    "social_engineering_comprehensive": ("SocialEngineering", 0.7, 3),
    "authority_manipulation_advanced": ("SocialEngineering", 0.85, 3),
    "encoding_bypass": ("EncodingBypass", None, 5),
    "encoding_bypass_comprehensive": ("EncodingBypass", None, 5),
    "context_confusion": ("ContextConfusion", 0.85, 5),
    "context_hijacking_advanced": ("ContextConfusion", 0.85, 5),
    "fake_system_messages_advanced": ("ContextConfusion", 0.85, 5),
    "data_extraction": ("DataExtraction", 0.9, 5),
    "hypothetical_scenarios_advanced": ("ContextConfusion", 0.65, 5),
    "role_playing": ("RolePlaying", 0.8, 5),
    "role_playing_comprehensive": ("RolePlaying", 0.8, 5),
    "advanced_instruction_override": ("InstructionOverride", 0.95, 7),
    "urgency_manipulation_advanced": ("SocialEngineering", 0.75, 7),
    "trust_manipulation_advanced": ("SocialEngineering", 0.7, 7),
    "dan_variations_comprehensive": ("Jailbreak", 0.98, 7),
    "gradual_escalation_patterns": ("SocialEngineering", 0.6, 7),
    "memory_data_extraction_advanced": ("DataExtraction", 0.9, 7),
    "evasion_techniques_advanced": ("ContextConfusion", 0.65, 7),
    "context_breaking_advanced": ("ContextConfusion", 0.6, 9),
    "compliance_testing_disguised": ("SocialEngineering", 0.7, 9),
    "jailbreak_comprehensive": ("Jailbreak", 0.98, 10),
}


@dataclass(frozen=True, order=True)
class SecurityLevel:
    value: int = 5

    def __post_init__(self) -> None:
        if not 0 <= self.value <= 10:
            raise ValueError(f"security level must be 0 to 10, not {self.value}")

    def _ramp(self, start: float, step: float) -> float:
        return float(F32(start) + F32(self.value) * F32(step))

    @property
    def base_threshold(self) -> float:
        return float(np.clip(F32(0.95) - F32(self.value) * F32(0.08), F32(0.15), F32(0.95)))

    @property
    def surely_bad(self) -> float:
        """Confidences above this count as malicious."""
        return float(F32(self.base_threshold) + F32(0.2))

    @property
    def surely_good(self) -> float:
        """Confidences below this count as benign."""
        return float(F32(self.base_threshold) - F32(0.2))

    def kept(self, share: float, least: float) -> float:
        """What is left of a confidence of which ``share`` goes at the middle levels."""
        return float(max(F32(1.0) - F32(share) * F32(self.adjustment), F32(least)))

    @property
    def pattern_weight(self) -> float:
        return self._ramp(1.0, 0.15)

    @property
    def heuristic_sensitivity(self) -> float:
        return self._ramp(0.1, 0.09)

    @property
    def combination_multiplier(self) -> float:
        return self._ramp(1.0, 0.2)

    @property
    def risk_floor(self) -> int:
        return 3 if self.value <= 2 else 2 if self.value <= 5 else 1 if self.value <= 8 else 0

    @property
    def thresholds(self) -> tuple[float, float, float, float]:
        """Least scores for critical, high, medium and low."""
        at = lambda start, step, least: float(max(F32(start) - F32(self.value) * F32(step), F32(least)))
        return at(0.98, 0.06, 0.35), at(0.90, 0.05, 0.30), at(0.80, 0.04, 0.25), at(0.70, 0.035, 0.20)

    @property
    def benign_factor(self) -> float:
        return float((F32(11.0) - F32(self.value)) / F32(100.0))

    @property
    def adjustment(self) -> float:
        return (1.5, 1.5, 1.5, 1.2, 1.2, 1.0, 1.0, 0.8, 0.8, 0.6, 0.6)[self.value]

    @property
    def encoding_base(self) -> float:
        return self._ramp(0.35, 0.04)

    @property
    def description(self) -> str:
        return LEVEL_TEXTS[self.value]

    @property
    def aggressive(self) -> bool:
        return self.base_threshold < 0.6

    @property
    def categories(self) -> list[str]:
        return [c for c, (_, _, first) in CATEGORIES.items() if self.value >= first]

    def decoder_base(self, rot13: bool = False) -> float:
        v = self.value
        if v <= 2:
            return self._ramp(0.15, 0.05)
        if v == 3:
            return 0.35
        if v == 4:
            return 0.42 if rot13 else 0.45
        start, step = (0.48, 0.02) if rot13 else (0.55, 0.03)
        return float(F32(start) + F32(v - 5) * F32(step))

    @property
    def decoder_bonus(self) -> float:
        return float(F32(self.value) / F32(10.0) + F32(0.5))


#: The older names for levels.
SEVERITY_LEVELS = {"Low": 2, "Medium": 5, "High": 7, "Paranoid": 10}
