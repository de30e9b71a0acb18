import pytest

from tellgrid.functions.kernel import Engine
from tellgrid.plans import profile as P
from tellgrid.plans.dialect import spelling_map, spelling_pairs
from tellgrid.plans.errors import ProfileCompileError, ProfileError, UnknownDialectError, UnknownPresetError
from tellgrid.plans.regex_dialect import compile_python, expand, required_literals, to_java
from tellgrid.plans.rules import compile_profile


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a++", r"a{1001}", "[a", "a(", "(?>a)", r"\8"])
def test_what_re2_rejects_raises(pattern):
    with pytest.raises(ProfileCompileError):
        compile_python(pattern)


def test_boundaries_and_classes_are_ascii_and_case_folds():
    assert compile_python(r"(?i)\brobust").search("ROBUſT")
    assert compile_python(r"\brobust").search("érobust").start() == 1
    assert compile_python(r"\d").search("٣") is None
    assert compile_python(r"a.b").search("a\rb")
    assert compile_python(r"a$").search("a\n") is None
    assert compile_python(r"(?m)^b$").findall("a\nb\nc") == ["b"]
    assert compile_python(r"\p{L}+").search("1é2")[0] == "é"
    assert to_java(r"\w$").endswith(r"\z")


def test_expansion():
    m = compile_python(r"(?P<a>x)(y)?").search("x")
    assert expand("$1-${a}-$2-$$-$1z", m) == "x-x--$-"


def test_required_literals():
    assert required_literals(r"(?i)\b(?:may|Might)\b[^.]{1,5}x") == ("may", "might")
    assert required_literals(r"[a-z]+") == ()


def test_dialects():
    assert len(spelling_pairs()) == 373
    assert sum(p.oneway for p in spelling_pairs()) == 35
    assert "check" not in spelling_map("british")
    british = sorted(p.british for p in spelling_pairs() if not p.oneway)
    # words whose American form has one British form come back
    back = spelling_map("british")
    keep = [w for w in british if back[spelling_map("american")[w]] == w]
    text = " ".join(keep)
    assert Engine(P.Profile(dialect="british")).clean(Engine(P.Profile(dialect="american")).clean(text)) == text
    with pytest.raises(UnknownDialectError):
        compile_profile(P.Profile(dialect="klingon"))
    assert Engine(P.Profile(dialect="OFF")).clean("colour") == "colour"


def test_preset_goes_under_and_skips_patterns():
    base = P.Profile(wordReplace={"leverage": "apply"}, flagPatterns={"x": "y"}, blockWords=("a",))
    got = P.apply_presets(base, ["cleaver"])
    assert got.wordReplace["leverage"] == "apply"
    assert got.wordReplace["robust"] == "solid"
    assert got.flagPatterns == {"x": "y"}
    assert got.blockWords[0] == "a" and not got.collapseSpaces
    with pytest.raises(UnknownPresetError, match="have academic, cleaver"):
        P.apply_presets(base, ["nope"])


def test_overlay_top_wins_and_switches_stay():
    got = P.overlay(P.Profile(wordReplace={"a": "1"}, collapseSpaces=True), P.Profile(wordReplace={"a": "2"}, flagPatterns={"n": "x"}, tone=("dry",)))
    assert got.wordReplace == {"a": "2"} and got.flagPatterns == {"n": "x"} and got.collapseSpaces and got.tone == ("dry",)


def test_voice():
    v = P.load_voice('{"keep": ["robust"], "prefer": {"utilize": "use", "in order to": "to", " ": "x"}, "avoid": ["synergy"]}')
    p = v.as_profile()
    assert (p.allow, p.blockWords, p.wordReplace, p.phraseReplace) == (("robust",), ("synergy",), {"utilize": "use"}, {"in order to": "to"})
    assert P.with_voice(P.default_profile(), P.Voice()) == P.default_profile()


def test_resolution_order():
    voice = P.Voice(prefer={"robust": "sturdy"})
    assert P.resolve(presets=["cleaver"], voice=voice).wordReplace["robust"] == "sturdy"
    own = P.Profile(wordReplace={"robust": "tough"})
    assert P.resolve(own, ["cleaver"], voice).wordReplace["robust"] == "tough"
    assert P.resolve(dialect="british").dialect == "british"


def test_loading():
    p = P.load_profile('{"blockWords": ["x"], "unknown": 1}')
    assert p.blockWords == ("x",) and not p.collapseSpaces
    assert P.load_profile(P.default_profile().to_json()).to_dict() == P.default_profile().to_dict()
    for bad in ("{", "[]", '{"blockWords": "x"}', '{"wordReplace": {"a": 1}}'):
        with pytest.raises(ProfileError):
            P.load_profile(bad)
    with pytest.raises(ProfileCompileError):
        compile_profile(P.Profile(regexReplace={"(": ""}))
    with pytest.raises(ProfileCompileError):
        compile_profile(P.Profile(flagPatterns={"x": "[a"}))


def test_options():
    assert P.option("max", {"max": "9"}, {"TELLGRID_MAX": "5"}) == 9
    assert P.option("max", {}, {"TELLGRID_MAX": "5"}) == 5
    assert P.option("max", {}, {"TELLGRID_MAX": "x"}) == -1
    assert P.option("verify-retry", {}, {}) == 1
    assert P.option("json", {}, {"TELLGRID_JSON": "true"}) is True
    assert P.option("base-url", {}, {"TELLGRID_BASE_URL": "u"}) == "u"
    for command, given, files in (("fix", {"write": "1", "json": "1"}, 1), ("fix", {"write": "1"}, 0), ("fix", {}, 2), ("fix", {"model": "m"}, 1), ("fix", {"verify": "1"}, 1), ("check", {"json": "1"}, 2), ("score", {"pretty": "1"}, 1)):
        with pytest.raises(ProfileError):
            P.validate_options(command, given, files)
    P.validate_options("fix", {"rewrite": "1", "verify": "1", "model": "m"}, 1)


def test_small_parsers():
    assert P.split_list(" a, ,b ,") == ["a", "b"]
    assert P.parse_pairs("a => b\n\nc\n d=>\n") == {"a": "b", "c": "", "d": ""}
    assert P.merge_tone(["Dry", "warm"], [" dry ", "Short"]) == ["Dry", "warm", "Short"]
    assert P.parse_tone_notes('Sure:\n["a", " ", "b"]') == ["a", "b"]
    with pytest.raises(ProfileError):
        P.parse_tone_notes("none")
