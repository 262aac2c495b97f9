import math

import pytest

from grainmill.operators.mitigate import Response, Strategy
from grainmill.plans.config import ConfigBuilder, ConfigError, Preset
from grainmill.plans.detector import Detector
from grainmill.plans.policy import READY_MADE, Features, Policy, PolicyBuilder, fnv1a64


def test_marker_covers_everything():
    assert fnv1a64(b"") == 0xCBF29CE484222325 and fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    p = PolicyBuilder.for_use_case("banking").build()
    assert Policy.from_json(p.to_json()).marker() == p.marker()
    assert PolicyBuilder(p).with_security_level(2).build().marker() != p.marker()
    assert p.clone(p.name).marker() != p.marker()
    later = Policy.from_json(p.to_json())
    later.updated_at = "2030-01-01T00:00:00+00:00"
    assert later.marker() != p.marker()


@pytest.mark.parametrize("kind", ["json", "yaml", "yml"])
def test_files_round_trip(tmp_path, kind):
    if kind != "json":
        pytest.importorskip("yaml")
    p = PolicyBuilder.for_use_case("banking").with_tags("x", "x", "y").set_category_sensitivity("jailbreak", 8).add_custom_patterns("abc").build_validated()
    assert p.tags == ["x", "y"] and abs(p.options.category_thresholds["jailbreak"] - 0.26) < 1e-9
    path = str(tmp_path / f"p.{kind}")
    p.save(path)
    again = Policy.load(path)
    assert again.marker() == p.marker() and again.config == p.config
    if kind == "yaml":
        assert Policy.from_yaml(p.to_yaml()).marker() == p.marker()
    with pytest.raises(ValueError):
        p.save(str(tmp_path / "p.txt"))


def with_options(**options):
    p = Policy("p")
    for k, v in options.items():
        setattr(p.options, k, v)
    return p


def test_errors():
    base = Policy("p").config.level.base_threshold
    for bad in (-0.1, 1.1, math.nan, math.inf):
        assert with_options(category_thresholds={"c": bad}).problems()[0]
    assert with_options(category_thresholds={"c": base - 0.49}).problems() == ([], [])
    assert len(with_options(category_thresholds={"c": base - 0.51}).problems()[0]) == 1
    for bad in (-1.0, math.nan, math.inf):
        assert with_options(threat_weights={"k": bad}).problems()[0]
    assert Policy("").problems()[0]
    with pytest.raises(ConfigError):
        with_options(threat_weights={"k": math.inf}).validate()
    with pytest.raises(ConfigError):
        PolicyBuilder().enabled(False).build().detector_config()


def test_warnings():
    warned = lambda b: b.build().problems()
    assert warned(PolicyBuilder()) == ([], [])
    assert len(warned(PolicyBuilder().enable_feature("semantic_detection"))[1]) == 1
    assert warned(PolicyBuilder().enable_semantic_analysis())[1] == []
    assert len(warned(PolicyBuilder().add_custom_patterns("a").disable_feature("pattern_matching"))[1]) == 1
    assert len(warned(PolicyBuilder().with_rate_limits(0, 1, 1))[1]) == 1
    p = PolicyBuilder().with_context_history(3).build()
    assert p.problems() == ([], [])
    p.options.context_window = 0
    assert len(p.problems()[1]) == 1


def test_merge_takes_what_is_set():
    mine = PolicyBuilder().with_security_level(7).with_response_strategy("warn").add_custom_patterns("abc").override_threshold("a", 0.4).with_tags("x").with_metadata("k", "1").build()
    plain = PolicyBuilder().with_version("9").with_tags("y").build()
    out = mine.merge(plain)
    assert (out.version, out.config.level.value, out.config.response, out.features) == ("9", 7, Response("warn"), mine.features)
    assert out.config.patterns.custom == ("abc",) and out.tags == ["x", "y"] and out.metadata == {"k": "1"}
    theirs = PolicyBuilder().with_security_level(2).with_response_strategy("allow").with_features(Features.minimal()).override_threshold("b", 0.5).override_threat_weight("w", 2.0).add_custom_patterns("q").build()
    out = mine.merge(theirs)
    assert (out.config.level.value, out.config.response.kind, out.features) == (2, "allow", Features.minimal())
    assert out.options.category_thresholds == {"a": 0.4, "b": 0.5} and out.options.threat_weights == {"w": 2.0}
    assert out.config.patterns.custom == ("abc",) and mine.config.level.value == 7


def test_features():
    assert len(Features.names()) == 14 and Features.from_map(Features.minimal().to_map()) == Features.minimal()
    assert set(Features.performance_optimized().enabled()) == {
        "pattern_matching", "encoding_detection", "context_hijacking_detection", "role_play_detection", "custom_patterns", "jailbreak_detection", "instruction_override_detection", "code_injection_detection"
    }
    off = {p: set(Features.of_preset(p).disabled()) for p in Preset}
    assert off[Preset.FINANCIAL] == off[Preset.HEALTHCARE] == set()
    assert off[Preset.CHAT_BOT] == {"semantic_detection", "multi_modal_detection", "data_extraction_detection", "code_injection_detection"}
    assert off[Preset.CODE_ASSISTANT] == off[Preset.EDUCATIONAL] == {"heuristic_analysis", "semantic_detection", "social_engineering_detection", "role_play_detection", "multi_modal_detection"}
    assert Features.of_preset(Preset.DEVELOPMENT) == Features.minimal() and Features.of_preset(Preset.CUSTOM) == Features.balanced()


def test_presets_carry_their_settings():
    c = {p: p.config() for p in Preset}
    assert [c[p].keywords.similarity_threshold for p in Preset] == [0.8, 0.85, 0.75, 0.8, 0.7, 0.75, 0.9, 0.8]
    assert [c[p].keywords.max_context_length for p in Preset] == [512, 1024, 512, 512, 1024, 1024, 256, 512]
    assert [c[p].preprocessing.preserve_formatting for p in Preset] == [False, True, False, True, True, True, True, False]
    assert [c[p].resources.max_concurrent_analyses for p in Preset] == [200, 50, 100, 150, 25, 50, 10, 100]
    assert Preset.CODE_ASSISTANT.metadata() == {"deployment_domain": "code_assistant", "preset_type": "code_assistant", "optimize_for": "technical_accuracy"}
    assert Policy.from_preset(Preset.CHAT_BOT, "n").features == Features.of_preset(Preset.CHAT_BOT)


def test_ready_made():
    made = {k: PolicyBuilder.ready_made(k).build_validated() for k in READY_MADE}
    assert [p.config.level.value for p in made.values()] == [2, 9, 5] and [p.config.resources.analysis_timeout_s for p in made.values()] == [1, 30, 5]
    assert made["maximum_security"].config.keywords.enabled and made["maximum_security"].summary()["custom_patterns"] == 4


def test_reconfiguration_is_validated():
    d = Detector(ConfigBuilder().with_security_level(3).build())
    assert d.reconfigured(ConfigBuilder().with_security_level(8).build()).config.level.value == 8
    with pytest.raises(ConfigError):
        d.reconfigured(ConfigBuilder().with_timeout(0).build())
    assert d.config.level.value == 3 and d.with_strategy("Jailbreak", Strategy("remove")).selector.of("Jailbreak") == Strategy("remove")
