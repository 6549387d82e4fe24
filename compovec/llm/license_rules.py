"""Signature rules of the license scan, as regular expressions over normalised words.

A text is lower-cased and its words are joined by single blanks, so "GPL-3.0" reads "gpl 3 0".  A rule is
(label, level, keyword, pattern): the pattern matches whole words, the keyword is a plain string that every
match contains and that is tested first.  Level 0 is the most specific (identifiers), 1 a grant, 2 a title,
3 a generic hint.  Rules are generated from families; the names below are fixed values of public licenses.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    level: int
    keyword: str
    pattern: str


#: Confidence that a detection of a level is a license statement.
WEIGHTS = (0.99, 0.9, 0.7, 0.3)

GRANT = (r"(?:(?:is |are |be )?(?:dual )?(?:released|licen[cs]ed|distributed|available|published|provided|made available|shared|redistributed)"
         r" (?:to you )?under (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:the |a |an )?)")
VERSION = r"(?: (?:version|v|ver) | v| )"
LATER = r" or (?:\(at your option\) )?(?:at your option )?(?:any )?later(?: version)?"

#: label, title words, keyword, identifier words
TITLES = [
    ("mit", r"(?:mit|expat|x11) licen[cs]e", "mit licen", "mit"), ("mit-0", r"mit no attribution", "mit no attribution", "mit 0"),
    ("isc", r"isc licen[cs]e", "isc licen", "isc"), ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", "zlib"),
    ("0bsd", r"(?:bsd zero clause|zero clause bsd|bsd 0 clause|0bsd)(?: licen[cs]e)?", "bsd ", "0bsd"),
    ("bsd-1", r"(?:bsd 1 clause|1 clause bsd|one clause bsd)(?: licen[cs]e)?", " bsd ", "bsd 1 clause"),
    ("bsd-2", r"(?:(?:simplified|freebsd|two clause|2 clause) bsd|bsd (?:2|two) clause)(?: licen[cs]e)?", " bsd ", "bsd 2 clause"),
    ("bsd-3", r"(?:(?:new|modified|revised|three clause|3 clause) bsd|bsd (?:3|three) clause)(?: licen[cs]e)?", " bsd ", "bsd 3 clause"),
    ("bsd-4", r"(?:(?:original|old|four clause|4 clause) bsd|bsd (?:4|four) clause)(?: licen[cs]e)?", " bsd ", "bsd 4 clause"),
    ("bsd", r"bsd(?: style)? licen[cs]e", " bsd ", "bsd"), ("boost", r"boost software licen[cs]e", "boost software", "bsl 1 0"),
    ("unlicense", r"(?:the )?unlicen[cs]e", "unlicen", "unlicense"), ("wtfpl", r"wtfpl", " wtfpl ", "wtfpl"), ("wtfpl", r"do what the fuck you want to public licen[cs]e", "you want to public licen", "wtfpl"),
    ("cc0", r"cc0(?: 1 0)?", " cc0 ", "cc0 1 0"), ("cc0", r"cc zero", " cc zero ", "cc0"), ("cc0", r"creative commons zero", "creative commons zero", "cc0"), ("public-domain", r"(?:in|into|to) the public domain", "public domain", "public domain"),
    ("python", r"psf licen[cs]e", "psf licen", "psf 2 0"), ("python", r"python software foundation licen[cs]e", "software foundation", "psf 2 0"), ("ruby", r"ruby licen[cs]e", "ruby licen", "ruby"),
    ("php", r"php licen[cs]e", "php licen", "php 3 01"), ("perl-artistic", r"artistic licen[cs]e", "artistic licen", "artistic 2 0"),
    ("zpl", r"zope public licen[cs]e", "zope public", "zpl 2 1"), ("ms-pl", r"microsoft public licen[cs]e", "microsoft public", "ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft reciprocal", "ms rl"), ("eupl", r"european union public licen[cs]e", "european union public", "eupl 1 2"), ("eupl", r"eupl", " eupl ", "eupl"),
    ("osl", r"open software licen[cs]e", "open software licen", "osl 3 0"), ("afl", r"academic free licen[cs]e", "academic free", "afl 3 0"),
    ("ncsa", r"(?:university of illinois ncsa|ncsa) (?:open source )?licen[cs]e", "ncsa", "ncsa"), ("upl", r"universal permissive licen[cs]e", "universal permissive", "upl 1 0"),
    ("blueoak", r"blue oak model licen[cs]e", "blue oak", "blueoak 1 0 0"), ("postgresql", r"postgresql licen[cs]e", "postgresql licen", "postgresql"),
    ("curl", r"curl licen[cs]e", "curl licen", "curl"), ("openssl", r"openssl licen[cs]e", "openssl licen", "openssl"),
    ("ofl", r"(?:sil )?open font licen[cs]e", "open font", "ofl 1 1"), ("odbl", r"open (?:data commons open )?database licen[cs]e", "database licen", "odbl 1 0"),
    ("odc-by", r"open data commons attribution licen[cs]e", "open data commons", "odc by 1 0"), ("pddl", r"public domain dedication and licen[cs]e", "public domain dedication", "pddl 1 0"),
    ("cecill", r"cecill(?: b| c)?(?: free software)? licen[cs]e", "cecill", "cecill 2 1"), ("beerware", r"beerware licen[cs]e", "beerware", "beerware"),
    ("sspl", r"server side public licen[cs]e", "server side public", "sspl 1 0"), ("busl", r"business source licen[cs]e", "business source", "busl 1 1"),
    ("elastic", r"elastic licen[cs]e", "elastic licen", "elastic 2 0"), ("vsl", r"vovida software licen[cs]e", "vovida", "vsl 1 0"),
    ("w3c", r"w3c software (?:notice and )?licen[cs]e", "w3c software", "w3c"), ("unicode", r"unicode licen[cs]e", "unicode licen", "unicode dfs 2016"),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m| s)? licen[cs]e", "rail", "openrail"),
]

#: Names that say a license by themselves after a grant or after the word license.
BARE = ("mit", "bsd", "isc", "zlib", "unlicense")

#: label, full title, its keyword, abbreviation, known versions; the title is what the grant and version forms are built from
VERSIONED = [
    ("gpl", r"(?:gnu )?general public licen[cs]e", "general public", "gpl", ("1", "2", "3")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public", "lgpl", ("2", "2 1", "3")),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero general", "agpl", ("1", "3")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "free documentation", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", r"apache(?: software)? licen[cs]e", " apache ", "apache", ("1 0", "1 1", "2", "2 0")),
    ("mpl", r"mozilla public licen[cs]e", "mozilla public", "mpl", ("1 0", "1 1", "2", "2 0")),
    ("epl", r"eclipse public licen[cs]e", "eclipse public", "epl", ("1 0", "2 0")),
    ("cddl", r"common development and distribution licen[cs]e", "common development", "cddl", ("1 0", "1 1")),
    ("cpl", r"common public licen[cs]e", "common public", "cpl", ("1 0",)),
]

CC_PARTS = {"": "attribution", "-sa": "attribution share ?alike", "-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
            "-nc": "attribution non ?commercial", "-nc-sa": "attribution non ?commercial share ?alike",
            "-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

GENERIC = [
    ("reserved", 2, "rights reserved", r"(?:all|some|no) rights(?: are)? reserved"),
    ("copyright", 3, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2,4})?"), ("copyright", 3, "copyright", r"copyright c"),
    ("copyright", 3, "copyright", r"copyright notice"), ("copyright", 2, "copyright", r"protected by copyright(?: law)?"),
    ("proprietary", 1, "proprietary", r"proprietary and confidential"), ("proprietary", 1, "proprietary", r"proprietary licen[cs]e"),
    ("proprietary", 1, "copying of this", r"unauthori[sz]ed copying of this (?:file|document|work)"),
    ("commercial", 2, "commercial licen", r"commercial licen[cs]e"), ("non-commercial", 2, "commercial use", r"(?:for )?non ?commercial use only"),
    ("permission", 1, "permission is hereby", r"permission is hereby granted(?: free of charge)?"),
    ("permission", 2, "permission", r"(?:used|reprinted|reproduced) (?:with|by) permission"),
    ("warranty", 3, "warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?"), ("warranty", 3, "provided as is", r"provided as is"),
    ("redistribution", 2, "redistribution", r"redistribution and use in source and binary forms"),
    ("license", 3, "licen", r"licen[cs]ed under"), ("license", 3, "licen", r"licen[cs]e agreement"), ("license", 3, "licen", r"end user licen[cs]e(?: agreement)?"),
    ("license", 3, "licen", r"see (?:the )?licen[cs]e(?: file)?(?: for details)?"), ("license", 3, "licen", r"(?:this|the) licen[cs]e"),
    ("license", 3, "licen", r"open source licen[cs]e"), ("license", 3, "licen", r"under (?:the )?licen[cs]e"), ("creative-commons", 2, "creative commons", r"creative commons"),
]


def build() -> list[Rule]:
    rules: list[Rule] = []
    for label, title, keyword, spdx in TITLES:
        title = f"(?:{title})"
        rules += [Rule(label, 0, f"identifier {spdx}", f"spdx licen[cs]e identifier {spdx}"), Rule(label, 1, keyword, GRANT + title),
                  Rule(label, 2, keyword, title)]
    for label, title, keyword, short, versions in VERSIONED:
        rules += [Rule(label, 1, keyword, GRANT + title), Rule(label, 2, keyword, title), Rule(label, 1, f" {short} ", GRANT + short)]
        if short.endswith("gpl") or short in ("mpl", "cddl", "gfdl"):
            rules.append(Rule(label, 2, f" {short} ", short))
        joint = "" if short in ("gpl", "lgpl", "agpl", "gfdl", "cddl", "apache") else "v"       # the others' bare digits are no license
        for v in versions:
            exact, own = f"{label}-{v.replace(' ', '.')}", rf"{v}(?! [0-9])" if " " in v else rf"{v}(?: 0)?(?! [0-9])"
            rules += [Rule(exact, 0, f"identifier {short} ", f"spdx licen[cs]e identifier {short} {own}(?: only| or later)?"),
                      Rule(exact, 1, f" {short}{joint}", f"{short}{joint or 'v?'}{own}"),         # joined, as in GPLv3
                      Rule(exact, 1, keyword, f"(?:{GRANT})?{title}{VERSION}{own}"), Rule(exact, 1, f" {short} ", f"{short}{VERSION}{own}"),
                      Rule(f"{exact}+", 0, keyword, f"(?:{GRANT})?{title}{VERSION}{own}{LATER}"), Rule(f"{exact}+", 0, f" {short} ", f"{short}{VERSION}{own}{LATER}")]
    for part, title in CC_PARTS.items():
        ident = "cc by" + part.replace("-", " ")
        word = f" {ident} "
        end = "" if part in ("-nc-sa", "-nc-nd", "-sa", "-nd") else r"(?! (?:sa|nd|nc|share|no|non)(?: |alike|deriv|commercial))"
        rules += [Rule(f"cc-by{part}", 2, word, ident + end), Rule(f"cc-by{part}", 1, word, GRANT + ident + end),
                  Rule(f"cc-by{part}", 2, "creative commons", f"creative commons {title}{end}(?: licen[cs]e)?"),
                  Rule(f"cc-by{part}", 1, "creative commons", f"{GRANT}creative commons {title}{end}(?: licen[cs]e)?")]
        rules += [Rule(f"cc-by{part}-{v.replace(' ', '.')}", 1, word, f"(?:{GRANT})?{ident} {v}") for v in CC_VERSIONS]
        rules += [Rule(f"cc-by{part}-{v.replace(' ', '.')}", 1, "creative commons", f"creative commons {title} {v}(?: international| unported)?") for v in CC_VERSIONS]
    for name in BARE:
        rules += [Rule(name, 1, f" {name} ", f"(?:dual )?licen[cs]ed (?:to you )?under (?:the |a |an )?(?:terms of )?(?:the )?{name}"), Rule(name, 1, f" {name} ", f"licen[cs]e (?:is |type )?{name}")]
    return rules + [Rule(*g) for g in GENERIC]


RULES = build()

#: Any text with a match of a rule or a base phrase contains, in lower case, one of these strings or one of these words.
GATE_STRINGS = ("licen", "copyright", "reserved", "creative", "domain", "proprietary", "permission", "warrant", "redistribution", "copying", "provided",
                "commercial", "attribution", "cc0", "0bsd", "gpl", "gfdl", "cddl", "wtfpl", "apache", "mplv", "eplv", "cplv")
GATE_WORDS = ("cc", "bsd", "mpl", "epl", "cpl", "eupl")
