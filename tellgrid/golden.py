"""Golden cases: inputs with the output that the rules must give.  Test data, independent of the code."""

from __future__ import annotations

from tellgrid.plans.profile import Profile, apply_presets, default_profile, load_preset

PROFILES = {
    "default": default_profile(),
    "default+cleaver": apply_presets(default_profile(), ["cleaver"]),
    "american": Profile(dialect="american"),
    "british": Profile(dialect="British"),
    "quotes": Profile(blockWords=("leverage",), wordReplace={"leverage": "use"}, protectQuotes=True),
    "swap": Profile(wordReplace={"foo": "bar", "bar": "foo"}),
    "grow": Profile(wordReplace={"use": "make use of"}),
    "brand": Profile(wordReplace={"github": "GitHub"}),
    "regex": Profile(regexReplace={r"([0-9]+) %": "$1 percent"}, collapseSpaces=True),
    "host": Profile(regexReplace={r"(\w+)@(\w+)": "$2.$1"}),
    "empty-match": Profile(regexReplace={"x*": "Z"}),
    "plain": load_preset("plain"),
    "marketing": load_preset("marketing"),
}

#: (profile, input, cleaned)
FIX = (
    ("default", "In summary, a comprehensive—and robust—plan; it works.", "A comprehensive, and robust, plan. It works."),
    ("default", "word — word", "word, word"),
    ("default", "It's worth\nnoting that it works", "It works"),
    ("default", "See 2.; the rest wins.", "See 2. The rest wins."),
    ("default", "We support Go; Python; and Rust.", "We support Go; Python; and Rust."),
    ("default", "note in summary,\n```\nx\n```", "note \n```\nx\n```"),
    ("default", "a ; b", "a. B"),
    ("default", "done .", "done."),
    ("default", "In summary,\nit ships", "It ships"),
    ("default", "| Kind    | Action    |", "| Kind    | Action    |"),
    ("default", "a FAQ entry, a hour, an user, an unicorn", "an FAQ entry, an hour, a user, a unicorn"),
    ("default", "keep `a  —  b` but fix a  —  b", "keep `a  —  b` but fix a, b"),
    ("default", "see [the — text](http://x.test/a—b) now", "see [the, text](http://x.test/a—b) now"),
    ("default", "zero​width and no break", "zerowidth and no break"),
    ("default", "    code — stays\n\ntext — moves", "    code — stays\n\ntext, moves"),
    ("default", "robust regression — yes", "robust regression, yes"),
    ("default", "one (a; b) two", "one (a; b) two"),
    ("default", "He left; and then came back.", "He left; and then came back."),
    ("default", "---\ntitle: a — b\n---\nbody — end", "---\ntitle: a — b\n---\nbody, end"),
    ("default", "More importantly, it runs.", "More it runs."),
    ("default+cleaver", "Seamlessly, the app scales.", "The app scales."),
    ("default+cleaver", "It is known, seamlessly, for speed.", "It is known, for speed."),
    ("default+cleaver", "I ordered on Seamless. Ask Delve about it. Seamless helps. We use seamless tools.", "I ordered on Seamless. Ask Delve about it. Smooth helps. We use smooth tools."),
    ("default+cleaver", "A myriad of options exist.", "Many options exist."),
    ("default+cleaver", "UTILIZE it in an innovative way", "USE it in a new way"),
    ("british", "we organize it", "we organise it"),
    ("british", "Check the meter of COLOR", "Check the meter of COLOUR"),
    ("american", "The Centre analysed grey tyres whilst I was there", "The Center analyzed gray tires while I was there"),
    ("quotes", 'She said "we leverage it" and we leverage it', 'She said "we leverage it" and we use it'),
    ("swap", "foo and bar", "bar and foo"),
    ("grow", "use it", "make use of it"),
    ("brand", "Github is down", "GitHub is down"),
    ("regex", "0  %", "0 percent"),
    ("host", "user@host here", "host.user here"),
    ("empty-match", "abc", "abc"),
    ("plain", "Prior to the release we require a number of fixes", "Before the release we need several fixes"),
    ("marketing", "A bespoke, curated kit.", "A custom, chosen kit."),
)

#: (profile, input, rule:line:col of each finding, in order)
CHECK = (
    ("default", "él robust\nplan robust here", "word:robust:1:4|word:robust:2:6"),
    ("default", "robust\nx — y", "word:robust:1:1|char:—:2:3"),
    ("default", "In summary, a comprehensive—and robust—plan; it works.", "phrase:in summary,:1:1|word:comprehensive:1:15|char:—:1:28|word:robust:1:33|char:—:1:39|semicolon:1:44"),
    ("default", "line one — prose-ignore\nline two — here", "char:—:2:10"),
    ("default", "prose-ignore-next-line\na — b\nc — d", "char:—:3:3"),
    ("default", "nothing to see", ""),
    ("default", "It's not fast, it's slow. Let's dive in!", "structural:its-not-x-its-y:1:1|structural:lets-dive-in:1:27"),
    ("default+cleaver", "We leverage it", "replace:1:4"),
)

#: (input, byte ranges of code)
CODE = (
    ("a `b` c", "2-5"),
    ("a ``b ` c`` d", "2-11"),
    ("before\n```\ncode\n```\nafter", "7-19"),
    ("```\nopen", "0-8"),
    ("é `ü` x", "3-7"),
    ("text\n\n    code\n    more\n\nend", "6-23"),
    ("text\n    not code", ""),
    ("stray ` tick\n\nother ` tick", ""),
    ("~~~\nx\n```\n~~~~\ny", "0-14"),
)

#: (input, anchors in order of their kinds)
ANCHORS = (
    ("grew from $4.2M to $4.2B", "$4.2M|$4.2B"),
    ("see https://x.test/a1 or mail a.b@c.test by 2024-05-01", "https://x.test/a1|a.b@c.test|2024-05-01"),
    ("up 12% on the NASA and HTTP2 list of 7", "12%|2|7|NASA|HTTP"),
    ("`code 42` and 43", "43"),
)
