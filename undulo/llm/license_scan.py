"""Licence detection by ordered signature rules, in DataFrame functions only.

A text becomes its words in lower case between single spaces. The rules are written out below: names of licences with the versions that they have, SPDX
identifiers, and sentences of notices and of the licences themselves; each has a level, 1 the surest.
A rule is tried on a text only if the text has its keyword; any hit of the rule, with the spaces
around it, contains it, so no hit is lost. Its hits become intervals of words. A hit that lies within another of a better level, or of the same level and longer, or equal and earlier in
the order of rules, is suppressed: it suffices to hold each hit's end against the farthest end of the hits before it in the order of start and falling end.

Beside the rules stand four base phrases, all places of which are counted.

Null texts count as empty: no words, no labels, score 0. Texts are scanned whole. Rows, their order, repeats and other
columns stay; a column named licenses is replaced.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm.common import hold, release, settle

#: The base phrases and their labels.
BASE = {"apache license": "apache", "cc by": "cc-by", "gnu general public license": "gpl", "mit license": "mit"}

_LIC = "licen[cs]e"
_UNDER = "(?:licensed|released|distributed|published|provided|available|covered|offered) under (?:the )?(?:terms of )?(?:the )?"
_LATER = "(?: only| or later| or any later version| or newer)?"

#: Label; keyword that any hit contains, at the start of a word; how a licence is named; level and how sure a hit is. Bare names that are words, people,
#: products or places of their own count only beside a licence word, and versions only where the licence has them.
NAMES = [
    ("afl", "academic free", f"academic free {_LIC}(?: version)?(?: v?[123] [0-9])?", 4, 0.85),
    ("afl", "afl", "afl v?(?:1 1|1 2|2 0|2 1|3 0)", 3, 0.7),
    ("agpl", "affero", f"(?:gnu )?affero (?:general )?public {_LIC}(?: version)?(?: v?[13](?: 0)?)?{_LATER}", 3, 0.9),
    ("agpl", "affero", "(?:gnu )?affero gpl(?: version)?(?: v?[13](?: 0)?)?", 4, 0.85),
    ("agpl", "agpl", f"(?:gnu )?agpl(?: version)? v?(?:1|3)(?: 0)?{_LATER}", 3, 0.85),
    ("agpl", "agplv", f"(?:gnu )?agplv[13](?: 0)?{_LATER}", 3, 0.85),
    ("agpl", "agpl", f"(?:gnu )?agpl(?:v[13])? {_LIC}d?", 4, 0.8),
    ("agpl", "agpl", "agpl", 5, 0.6),
    ("apache", "apache", f"apache (?:software )?{_LIC}", 4, 0.75),
    ("apache", "apache", f"apache (?:software )?{_LIC}(?: version)? v?2(?: 0)?", 3, 0.9),
    ("apache", "apache", f"apache (?:software )?{_LIC}(?: version)? v?1 [01]", 3, 0.85),
    ("apache", "apache", f"apache (?:version )?v?(?:1 0|1 1|2 0) {_LIC}d?", 3, 0.85),
    ("apache", "apache", f"{_UNDER}apache(?: software)?(?: {_LIC})?(?:(?: version)? v?2(?: 0)?)?", 2, 0.95),
    ("apache", "apache", f"{_LIC}s? (?:is |type |name )?(?:the )?apache(?: 2(?: 0)?)?", 5, 0.6),
    ("apache", "apache2", f"apache2 {_LIC}", 4, 0.75),
    ("apache", "asl", f"asl 2 0|{_LIC} asl2", 4, 0.7),
    ("apsl", "apple public source", f"apple public source {_LIC}(?: version)?(?: v?[12](?: [012])?)?", 4, 0.9),
    ("apsl", "apsl", "apsl v?(?:1 [0-2]|2(?: 0)?)", 3, 0.75),
    ("artistic", "artistic", f"(?:perl |clarified )?artistic {_LIC}", 4, 0.75),
    ("artistic", "artistic", f"(?:perl |clarified )?artistic {_LIC}(?: version)? v?[12](?: 0)?", 3, 0.85),
    ("artistic", "artistic", f"{_UNDER}artistic(?: {_LIC})?(?: v?[12](?: 0)?)?", 2, 0.9),
    ("artistic", "same terms as perl", "same terms as perl itself", 4, 0.75),
    ("beerware", "beer", f"beer ?ware {_LIC}", 4, 0.8),
    ("blueoak", "blue oak model", f"blue oak model {_LIC}(?: 1 0 0)?", 4, 0.9),
    ("boost", "boost", f"boost (?:software )?{_LIC}", 4, 0.8),
    ("boost", "boost", f"boost (?:software )?{_LIC}(?: version)? v?1(?: 0)?", 3, 0.9),
    ("boost", "boost", f"{_UNDER}boost(?: software)?(?: {_LIC})?(?:(?: version)? v?1(?: 0)?)?", 2, 0.9),
    ("boost", "boost org license", "boost org license 1 0(?: txt)?", 3, 0.85),
    ("bsd", "bsd", f"bsd {_LIC}", 4, 0.75),
    ("bsd", "bsd", f"bsd(?: style| like| type) {_LIC}", 4, 0.7),
    ("bsd", "bsd", f"(?:new|simplified|modified|revised|original|old) bsd(?: {_LIC})?", 4, 0.75),
    ("bsd", "bsd", f"bsd [0-4] clause(?: {_LIC})?", 3, 0.85),
    ("bsd", "bsd", f"(?:[0-4]|zero|one|two|three|four) clause bsd(?: {_LIC})?", 3, 0.85),
    ("bsd", "bsd", f"{_UNDER}(?:(?:new|simplified|modified|revised|original|[0-4] clause) )?bsd(?: [0-4] clause)?(?: {_LIC}| terms)?", 2, 0.95),
    ("bsd", "bsd", f"{_LIC}s? (?:is |type |name )?(?:the )?bsd(?: [0-4] clause)?", 5, 0.6),
    ("bsd", "freebsd", f"freebsd {_LIC}", 4, 0.75),
    ("bsd", "berkeley", f"berkeley software distribution {_LIC}", 4, 0.8),
    ("busl", "business source", f"business source {_LIC}(?: version)?(?: 1 [01])?", 4, 0.9),
    ("cc-by", "cc by", "cc by", 4, 0.75),
    ("cc-by", "cc by", "cc by (?:[12] [05]|[34] 0)(?: international| unported| generic)?", 3, 0.9),
    ("cc-by", "creative commons attribution", f"creative commons attribution(?: (?:[12] [05]|[34] 0))?(?: international| unported| generic)?(?: public)? {_LIC}", 3, 0.9),
    ("cc-by", "creative commons attribution", "creative commons attribution (?:[12] [05]|[34] 0)(?: international| unported| generic)?", 3, 0.85),
    ("cc-by", "creative commons attribution", f"{_UNDER}(?:a )?creative commons attribution(?: (?:[12] [05]|[34] 0))?(?: international| unported| generic)?", 2, 0.95),
    ("cc-by-nc", "cc by nc", "cc by nc(?: (?:[12] [05]|[34] 0))?", 3, 0.9),
    ("cc-by-nc", "creative commons attribution non", f"creative commons attribution non ?commercial(?: (?:[12] [05]|[34] 0))?(?: international| unported| generic)?(?: public)?(?: {_LIC})?", 2, 0.95),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: (?:[12] [05]|[34] 0))?", 3, 0.9),
    ("cc-by-nc-nd", "creative commons attribution non", f"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: (?:[12] [05]|[34] 0))?(?: international| unported| generic)?(?: public)?(?: {_LIC})?", 2, 0.95),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: (?:[12] [05]|[34] 0))?", 3, 0.9),
    ("cc-by-nc-sa", "creative commons attribution non", f"creative commons attribution non ?commercial share ?alike(?: (?:[12] [05]|[34] 0))?(?: international| unported| generic)?(?: public)?(?: {_LIC})?", 2, 0.95),
    ("cc-by-nd", "cc by nd", "cc by nd(?: (?:[12] [05]|[34] 0))?", 3, 0.9),
    ("cc-by-nd", "creative commons attribution no", f"creative commons attribution no ?deriv(?:s|atives|ative works)(?: (?:[12] [05]|[34] 0))?(?: international| unported| generic)?(?: public)?(?: {_LIC})?", 2, 0.95),
    ("cc-by-sa", "cc by sa", "cc by sa(?: (?:[12] [05]|[34] 0))?", 3, 0.9),
    ("cc-by-sa", "creative commons attribution share", f"creative commons attribution share ?alike(?: (?:[12] [05]|[34] 0))?(?: international| unported| generic)?(?: public)?(?: {_LIC})?", 2, 0.95),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 4, 0.8),
    ("cc0", "creative commons", f"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: {_LIC})?", 2, 0.95),
    ("cddl", "common development and distribution", f"common development and distribution {_LIC}(?: version)?(?: v?1 [01])?", 4, 0.9),
    ("cddl", "cddl", "cddl v?1(?: [01])?", 3, 0.8),
    ("cddl", "cddl", f"{_UNDER}cddl|cddl {_LIC}", 4, 0.8),
    ("cecill", "cecill", f"cecill(?: [bc])?(?: v?[12](?: [01])?)?(?: {_LIC})?", 4, 0.8),
    ("cpl", "common public", f"common public {_LIC}(?: version)?(?: v?1(?: 0)?)?", 4, 0.85),
    ("cpl", "ibm public", f"ibm public {_LIC}(?: version)?(?: v?1(?: 0)?)?", 4, 0.85),
    ("ecl", "educational community", f"educational community {_LIC}(?: version)?(?: v?[12](?: 0)?)?", 4, 0.9),
    ("epl", "eclipse public", f"eclipse public {_LIC}", 4, 0.8),
    ("epl", "eclipse public", f"eclipse public {_LIC}(?: version)?(?: v)? ?[12](?: 0)?", 3, 0.9),
    ("epl", "eclipse public", f"{_UNDER}eclipse public(?: {_LIC})?(?:(?: version)? v?[12](?: 0)?)?", 2, 0.95),
    ("epl", "epl", "epl v?(?:1|2) 0", 3, 0.75),
    ("epl", "eclipse distribution", f"eclipse distribution {_LIC}(?: v)?(?: ?1 0)?", 4, 0.8),
    ("eupl", "european union public", f"european union public {_LIC}(?: version)?(?: v?1(?: [012])?)?", 4, 0.9),
    ("eupl", "eupl", "eupl(?: v?1 [012])?", 4, 0.75),
    ("ftl", "freetype", f"freetype(?: project)? {_LIC}", 4, 0.85),
    ("gfdl", "free documentation", f"(?:gnu )?free documentation {_LIC}(?: version)?(?: v?1 [123])?{_LATER}", 4, 0.9),
    ("gfdl", "gfdl", "(?:gnu )?gfdl(?: v?1 [123])?", 4, 0.8),
    ("gpl", "gnu", f"gnu general public {_LIC}", 4, 0.75),
    ("gpl", "general public", f"(?:gnu )?general public {_LIC}(?: version)? v?[123](?: 0)?{_LATER}", 3, 0.9),
    ("gpl", "general public", f"{_UNDER}(?:gnu )?general public {_LIC}(?:(?: version)? v?[123](?: 0)?)?{_LATER}", 2, 0.95),
    ("gpl", "gpl", f"(?:gnu )?gpl(?: version)? v?[123](?: 0)?{_LATER}", 3, 0.85),
    ("gpl", "gplv", f"(?:gnu )?gplv[123](?: 0)?{_LATER}", 3, 0.85),
    ("gpl", "gpl", f"(?:gnu )?gpl(?:v[123])? {_LIC}d?", 4, 0.8),
    ("gpl", "gpl", f"{_UNDER}(?:gnu )?gpl(?:v[123])?", 2, 0.9),
    ("gpl", "gnu", "gnu gpl", 4, 0.75),
    ("gpl", "gnu", f"gnu public {_LIC}", 4, 0.7),
    ("gpl", "gpl", f"{_LIC}s? (?:is |type |name )?(?:the )?(?:gnu )?gpl(?:v[123])?", 5, 0.6),
    ("hpnd", "historical permission notice", "historical permission notice and disclaimer", 4, 0.85),
    ("ijg", "independent jpeg group", f"independent jpeg group {_LIC}", 4, 0.85),
    ("isc", "isc", f"isc {_LIC}", 4, 0.8),
    ("isc", "isc", f"{_UNDER}isc(?: {_LIC})?", 2, 0.9),
    ("isc", "isc", f"{_LIC} (?:is |type |name )?isc", 5, 0.6),
    ("lgpl", "lesser general public", f"(?:gnu )?lesser general public {_LIC}", 4, 0.85),
    ("lgpl", "lesser general public", f"(?:gnu )?lesser general public {_LIC}(?: version)? v?(?:2 1|3(?: 0)?){_LATER}", 3, 0.9),
    ("lgpl", "lesser general public", f"{_UNDER}(?:gnu )?lesser general public {_LIC}(?:(?: version)? v?(?:2 1|3(?: 0)?))?{_LATER}", 2, 0.95),
    ("lgpl", "library general public", f"(?:gnu )?library general public {_LIC}(?: version)?(?: v?2(?: 0)?)?{_LATER}", 3, 0.9),
    ("lgpl", "lgpl", f"(?:gnu )?lgpl(?: version)? v?(?:2(?: [01])?|3(?: 0)?){_LATER}", 3, 0.85),
    ("lgpl", "lgplv", f"(?:gnu )?lgplv(?:2(?: 1)?|3){_LATER}", 3, 0.85),
    ("lgpl", "lgpl", f"(?:gnu )?lgpl(?:v[23])? {_LIC}d?", 4, 0.8),
    ("lgpl", "lgpl", f"{_UNDER}(?:gnu )?lgpl(?:v[23])?", 2, 0.9),
    ("lgpl", "lgpl", "lgpl", 5, 0.6),
    ("lppl", "latex project public", f"latex project public {_LIC}(?: version)?(?: v?1(?: [0-3][ac]?)?)?", 4, 0.9),
    ("mit", "mit", f"mit {_LIC}", 4, 0.75),
    ("mit", "mit", f"mit(?: style| like| x11| expat) {_LIC}", 4, 0.75),
    ("mit", "mit", f"{_UNDER}mit(?: {_LIC})?", 2, 0.95),
    ("mit", "mit", f"{_LIC}s? (?:is |type |name )?(?:the )?mit", 5, 0.6),
    ("mit", "mit licensed", "mit licensed", 4, 0.75),
    ("mit", "expat", f"expat {_LIC}", 4, 0.8),
    ("mit", "expat", f"{_UNDER}expat(?: {_LIC})?", 2, 0.9),
    ("mpl", "mozilla public", f"mozilla public {_LIC}", 4, 0.8),
    ("mpl", "mozilla public", f"mozilla public {_LIC}(?: version)? v?(?:1 [01]|2(?: 0)?)", 3, 0.9),
    ("mpl", "mozilla public", "mozilla public(?: version)? v?(?:1 [01]|2(?: 0)?)", 3, 0.8),
    ("mpl", "mozilla public", f"{_UNDER}mozilla public(?: {_LIC})?(?:(?: version)? v?(?:1 [01]|2(?: 0)?))?", 2, 0.95),
    ("mpl", "mpl", "mpl v?(?:1 [01]|2 0)", 3, 0.8),
    ("mpl", "mplv", "mplv2(?: 0)?", 3, 0.8),
    ("mpl", "mpl", f"mpl {_LIC}|{_UNDER}mpl", 4, 0.8),
    ("ms-pl", "microsoft public", f"microsoft public {_LIC}(?: ms pl)?", 4, 0.9),
    ("ms-pl", "ms pl", f"ms pl {_LIC}|{_LIC} ms pl", 4, 0.7),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {_LIC}(?: ms rl)?", 4, 0.9),
    ("mulan", "mulan", f"mulan (?:permissive|psl)(?: software)?(?: {_LIC})?(?: v?[12])?", 4, 0.85),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_LIC}", 4, 0.85),
    ("odbl", "open database", f"open (?:data commons open )?database {_LIC}(?: odbl)?(?: v?1 0)?", 4, 0.85),
    ("odbl", "odbl", "odbl(?: v?1 0)?", 4, 0.75),
    ("odc-by", "open data commons attribution", f"open data commons attribution {_LIC}(?: odc by)?(?: v?1 0)?", 3, 0.9),
    ("ofl", "open font", f"(?:sil )?open font {_LIC}", 4, 0.85),
    ("ofl", "open font", f"(?:sil )?open font {_LIC}(?: version)? v?1 [01]", 3, 0.9),
    ("ofl", "sil ofl", "sil ofl(?: 1 [01])?", 3, 0.85),
    ("openssl", "openssl", f"openssl {_LIC}", 4, 0.8),
    ("osl", "open software", f"open software {_LIC}(?: version)?(?: v?[123] [01])?", 4, 0.8),
    ("osl", "osl", "osl v?(?:1 [01]|2 [01]|3 0)", 3, 0.7),
    ("pddl", "public domain dedication", f"(?:open data commons )?public domain dedication and {_LIC}", 4, 0.85),
    ("php", "php", f"php {_LIC}", 4, 0.75),
    ("php", "php", f"php {_LIC}(?: version)? v?3(?: 0[01]?)?", 3, 0.85),
    ("postgresql", "postgresql", f"postgresql {_LIC}", 4, 0.8),
    ("psf", "python", f"python(?: software foundation)? {_LIC}", 4, 0.75),
    ("psf", "python software foundation", f"python software foundation {_LIC}(?: version)? v?2(?: 0)?", 3, 0.9),
    ("psf", "psf", f"psf {_LIC}|{_LIC} psf", 4, 0.75),
    ("ruby", "ruby", f"ruby {_LIC}", 4, 0.7),
    ("ruby", "ruby", f"{_UNDER}ruby {_LIC}|{_UNDER}same terms as ruby", 2, 0.9),
    ("sspl", "server side public", f"server side public {_LIC}(?: version)?(?: v?1(?: 0)?)?", 4, 0.9),
    ("sspl", "sspl", f"sspl v?1(?: 0)?|sspl {_LIC}", 4, 0.75),
    ("unicode", "unicode", f"unicode(?: inc)? {_LIC}(?: agreement)?(?: v?3)?", 4, 0.8),
    ("unlicense", "unlicense", f"{_UNDER}unlicense", 2, 0.95),
    ("unlicense", "unlicense", "(?:the )?unlicense(?: org)?", 4, 0.75),
    ("upl", "universal permissive", f"universal permissive {_LIC}(?: version)?(?: v?1 0)?", 4, 0.9),
    ("vim", "vim", f"vim {_LIC}", 4, 0.75),
    ("w3c", "w3c", f"w3c (?:software (?:and document )?(?:notice and )?)?{_LIC}", 4, 0.85),
    ("wtfpl", "wtfpl", "wtfpl(?: v?(?:ersion )?[12])?", 4, 0.85),
    ("x11", "x11", f"x11 {_LIC}", 4, 0.8),
    ("x11", "x consortium", f"x consortium {_LIC}", 4, 0.8),
    ("zlib", "zlib", f"zlib(?: libpng)? {_LIC}", 4, 0.8),
    ("zlib", "zlib", f"{_UNDER}zlib(?: libpng)?(?: {_LIC})?", 2, 0.9),
    ("zlib", "libpng", f"libpng {_LIC}(?: version)?(?: 2(?: 0)?)?", 4, 0.8),
    ("zpl", "zope public", f"zope public {_LIC}(?: version)?(?: v?[12](?: [01])?)?", 4, 0.9),
]

#: Label; SPDX identifiers as words. Versions that are written with only, or later or + are covered by those without.
IDS = {
    "afl": "afl 1 1|afl 1 2|afl 2 0|afl 2 1|afl 3 0",
    "agpl": "agpl 1 0|agpl 3 0",
    "apache": "apache 1 0|apache 1 1|apache 2 0",
    "apsl": "apsl 1 0|apsl 1 1|apsl 1 2|apsl 2 0",
    "artistic": "artistic 1 0|artistic 1 0 perl|artistic 1 0 cl8|artistic 2 0|clartistic",
    "blueoak": "blueoak 1 0 0",
    "boost": "bsl 1 0",
    "bsd": "0bsd|bsd 1 clause|bsd 2 clause|bsd 2 clause patent|bsd 2 clause views|bsd 3 clause|bsd 3 clause clear|bsd 3 clause lbnl|bsd 3 clause attribution|bsd 4 clause|bsd 4 clause uc|bsd source code",
    "busl": "busl 1 1",
    "cc-by": "cc by 1 0|cc by 2 0|cc by 2 5|cc by 3 0|cc by 4 0",
    "cc-by-nc": "cc by nc 1 0|cc by nc 2 0|cc by nc 2 5|cc by nc 3 0|cc by nc 4 0",
    "cc-by-nc-nd": "cc by nc nd 1 0|cc by nc nd 2 0|cc by nc nd 2 5|cc by nc nd 3 0|cc by nc nd 4 0",
    "cc-by-nc-sa": "cc by nc sa 1 0|cc by nc sa 2 0|cc by nc sa 2 5|cc by nc sa 3 0|cc by nc sa 4 0",
    "cc-by-nd": "cc by nd 1 0|cc by nd 2 0|cc by nd 2 5|cc by nd 3 0|cc by nd 4 0",
    "cc-by-sa": "cc by sa 1 0|cc by sa 2 0|cc by sa 2 5|cc by sa 3 0|cc by sa 4 0",
    "cc0": "cc0 1 0",
    "cddl": "cddl 1 0|cddl 1 1",
    "cecill": "cecill 1 0|cecill 1 1|cecill 2 0|cecill 2 1|cecill b|cecill c",
    "cpl": "cpl 1 0|ipl 1 0",
    "curl": "curl",
    "ecl": "ecl 1 0|ecl 2 0",
    "epl": "epl 1 0|epl 2 0",
    "eupl": "eupl 1 0|eupl 1 1|eupl 1 2",
    "ftl": "ftl",
    "gfdl": "gfdl 1 1|gfdl 1 2|gfdl 1 3",
    "gpl": "gpl 1 0|gpl 2 0|gpl 3 0",
    "hpnd": "hpnd",
    "ijg": "ijg",
    "isc": "isc",
    "lgpl": "lgpl 2 0|lgpl 2 1|lgpl 3 0|lgpllr",
    "lppl": "lppl 1 0|lppl 1 1|lppl 1 2|lppl 1 3a|lppl 1 3c",
    "mit": "mit|mit 0|mit modern variant",
    "mpl": "mpl 1 0|mpl 1 1|mpl 2 0|mpl 2 0 no copyleft exception",
    "ms-pl": "ms pl",
    "ms-rl": "ms rl",
    "mulan": "mulanpsl 1 0|mulanpsl 2 0",
    "ncsa": "ncsa",
    "odbl": "odbl 1 0",
    "odc-by": "odc by 1 0",
    "ofl": "ofl 1 0|ofl 1 1|ofl 1 1 rfn|ofl 1 1 no rfn",
    "openssl": "openssl",
    "osl": "osl 1 0|osl 1 1|osl 2 0|osl 2 1|osl 3 0",
    "pddl": "pddl 1 0",
    "php": "php 3 0|php 3 01",
    "postgresql": "postgresql",
    "psf": "psf 2 0|python 2 0",
    "ruby": "ruby",
    "unicode": "unicode dfs 2015|unicode dfs 2016|unicode 3 0",
    "unlicense": "unlicense",
    "upl": "upl 1 0",
    "vim": "vim",
    "w3c": "w3c",
    "wtfpl": "wtfpl",
    "x11": "x11",
    "zlib": "zlib|zlib acknowledgement|libpng|libpng 2 0",
    "zpl": "zpl 1 1|zpl 2 0|zpl 2 1",
}

#: Label; keyword; sentence of a notice or of the licence itself, or its address; level and how sure a hit is.
SENTENCES = [
    ("mit", "any person obtaining a copy of this software and associated documentation", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files?", 2, 0.95),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge(?: to any person obtaining a copy(?: of this software)?)?", 5, 0.6),
    ("mit", "shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 5, 0.6),
    ("boost", "any person or organization obtaining a copy of the software and accompanying", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 2, 0.95),
    ("ofl", "obtaining a copy of the font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 2, 0.95),
    ("ofl", "this font software is licensed under", "this font software is licensed under the sil open font license(?: version [0-9]+(?: [0-9]+)?)?", 2, 0.95),
    ("unicode", "obtaining a copy of the unicode data files", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 2, 0.95),
    ("ncsa", "to deal with the software without restriction", "to deal with the software without restriction including without limitation the rights to use", 2, 0.9),
    ("x11", "the name of the x consortium shall not be used", "except as contained in this notice the name of the x consortium shall not be used in advertising", 2, 0.95),
    ("isc", "this software for any purpose with or without fee is hereby granted provided", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 2, 0.95),
    ("bsd", "this software for any purpose with or without fee is hereby granted", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 3, 0.8),
    ("hpnd", "this software and its documentation for any purpose", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose(?: and without fee| is hereby granted without fee)(?: is hereby granted)?", 3, 0.8),
    ("postgresql", "without fee and without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 2, 0.95),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms(?: with or without modification are permitted)?(?: provided that the following conditions are met)?", 2, 0.9),
    ("bsd", "redistributions of source code must retain the", "redistributions of source code must retain the (?:above )?copyright notice", 4, 0.75),
    ("bsd", "redistributions in binary form must reproduce the", "redistributions in binary form must reproduce the (?:above )?copyright notice", 4, 0.75),
    ("bsd", "advertising materials mentioning features or use of this software", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 3, 0.8),
    ("apache", "may not use this file except in compliance with the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 2, 0.95),
    ("apache", "contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", 2, 0.9),
    ("apache", "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements", 2, 0.95),
    ("apache", "apache org licenses", "apache org licenses license 2 0", 3, 0.8),
    ("gpl", "under the terms of the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?", 2, 0.95),
    ("lgpl", "general public license", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license(?: as published by the free software foundation)?", 2, 0.95),
    ("agpl", "affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation)?", 2, 0.95),
    ("gpl", "to be licensed as a whole at no charge", "contains or is derived from the program or any part thereof to be licensed as a whole at no charge", 2, 0.9),
    ("gpl", "license is a free copyleft license for software", "the gnu general public license is a free copyleft license for software and other kinds of works", 2, 0.95),
    ("agpl", "to ensure cooperation with the community in the case of network server software", "specifically designed to ensure cooperation with the community in the case of network server software", 2, 0.95),
    ("agpl", "must prominently offer all users interacting with it remotely", "your modified version must prominently offer all users interacting with it remotely through a computer network", 2, 0.95),
    ("lgpl", "general public license applies to some specially designated software", "this license the (?:lesser|library) general public license applies to some specially designated software", 2, 0.95),
    ("lgpl", "license incorporates the terms and conditions of version 3 of the gnu general public license", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 2, 0.95),
    ("gpl", "gnu org licenses gpl", "gnu org licenses gpl(?: [0-9]+ [0-9]+)?", 3, 0.8),
    ("lgpl", "gnu org licenses lgpl", "gnu org licenses lgpl(?: [0-9]+ [0-9]+)?", 3, 0.8),
    ("agpl", "gnu org licenses agpl", "gnu org licenses agpl(?: [0-9]+ [0-9]+)?", 3, 0.8),
    ("gfdl", "under the terms of the gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 2, 0.95),
    ("gfdl", "to make a manual textbook or other functional and useful document", "the purpose of this license is to make a manual textbook or other functional and useful document free", 2, 0.95),
    ("mpl", "source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license(?: v 2 0)?", 2, 0.95),
    ("mpl", "subject to the mozilla public license", "the contents of this file are subject to the mozilla public license(?: version [0-9]+ [0-9]+)?", 2, 0.95),
    ("mpl", "if a copy of the mpl was not distributed with this file", "if a copy of the mpl was not distributed with this file you can obtain one at", 2, 0.95),
    ("epl", "under the terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license", 2, 0.95),
    ("epl", "program is provided under the terms of this eclipse public license", "the accompanying program is provided under the terms of this eclipse public license", 2, 0.95),
    ("cpl", "program is provided under the terms of this common public license", "the accompanying program is provided under the terms of this common public license", 2, 0.95),
    ("cddl", "subject to the terms of the common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license", 2, 0.95),
    ("apsl", "subject to the apple public source license", "original code as defined in and that are subject to the apple public source license", 2, 0.95),
    ("zlib", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented(?: you must not claim that you wrote the original software)?", 2, 0.95),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such(?: and must not be misrepresented as being the original software)?", 2, 0.9),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain", 2, 0.95),
    ("wtfpl", "do what the fuck you want to", "(?:you just )?do what the fuck you want to(?: public licen[cs]e)?", 2, 0.95),
    ("cc0", "dedicated the work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain", 2, 0.95),
    ("cc0", "waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights to", 2, 0.9),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero(?: 1 0)?", 3, 0.8),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by(?: [0-9] [0-9])?", 3, 0.8),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa(?: [0-9] [0-9])?", 3, 0.8),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd(?: [0-9] [0-9])?", 3, 0.8),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc(?: [0-9] [0-9])?", 3, 0.8),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa(?: [0-9] [0-9])?", 3, 0.8),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd(?: [0-9] [0-9])?", 3, 0.8),
    ("artistic", "to state the conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied", 2, 0.95),
    ("psf", "license agreement is between the python software foundation", "this license agreement is between the python software foundation", 2, 0.95),
    ("php", "of the php license", "this source file is subject to version [0-9]+ [0-9]+ of the php license", 2, 0.95),
    ("openssl", "developed by the openssl project for use in the openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 2, 0.95),
    ("ms-pl", "governs use of the accompanying software", "this license governs use of the accompanying software if you use the software you accept this license", 3, 0.8),
    ("odbl", "license agreement intended to allow users to freely share modify and use this database", "license agreement intended to allow users to freely share modify and use this database", 2, 0.95),
    ("cecill", "license under french law and abiding by the rules of distribution of free software", "this software is governed by the cecill(?: [bc])? license under french law and abiding by the rules of distribution of free software", 2, 0.95),
    ("vim", "no restrictions on distributing unmodified copies of vim", "there are no restrictions on distributing unmodified copies of vim", 2, 0.95),
    ("ruby", "you may make and give away verbatim copies of the source form of the software", "you may make and give away verbatim copies of the source form of the software without restriction", 2, 0.9),
    ("zpl", "subject to the provisions of the zope public license", "this software is subject to the provisions of the zope public license", 2, 0.95),
    ("upl", "obtaining a copy of this software associated documentation and or data", "to any person obtaining a copy of this software associated documentation and or data", 2, 0.95),
    ("blueoak", "license is to give everyone as much permission to work with this software as possible", "the purpose of this license is to give everyone as much permission to work with this software as possible", 2, 0.9),
    ("lppl", "under the conditions of the latex project public license", "this work may be distributed and or modified under the conditions of the latex project public license", 2, 0.95),
]

#: Levels of rules, 1 the surest.
LEVELS = (1, 2, 3, 4, 5)
#: Stems of which a rule's keyword may have one; texts without a stem are not searched for its keywords.
STEMS = ("spdx", "licen", "public", "softw", "redistributi", "permission", "creative", "gpl", "gnu", "bsd", "apache")


@cache
def rules() -> list[tuple[str, str, str, int, int, float]]:
    """keyword, pattern, label, level, order, confidence. Any hit, with the spaces around it, contains the keyword."""
    said = [(f" {key}", named, label, level, sure) for label, key, named, level, sure in NAMES]
    tags = [(f" {name} ", f"spdx licen[cs]e identifier {name}(?: only| or later)?", label, 1, 1.0) for label, names in IDS.items() for name in names.split("|")]
    spelled = [(f" {key}", sentence, label, level, sure) for label, key, sentence, level, sure in SENTENCES]
    return [(key, f"(?<= )(?:{pattern})(?= )", label, level, k, sure) for k, (key, pattern, label, level, sure) in enumerate(said + tags + spelled)]


def need(keyword: str, pattern: str) -> str:
    """What a text must contain, cheaper to look for than each of the keywords: the tag of an identifier, or a stem of the keyword."""
    return "spdx" if "spdx" in pattern else next((stem for stem in STEMS if stem in keyword), "")


def _rule_table() -> list[tuple[str, str, list[tuple]]]:
    """The rules by anchor and keyword."""
    groups: dict[tuple[str, str], list[tuple]] = {}
    for keyword, pattern, label, level, place, sure in rules():
        groups.setdefault((need(keyword, pattern), keyword), []).append((place, pattern, label, level, sure))
    return [(*both, group) for both, group in groups.items()]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _hits(text: Column, rule: Column) -> Column:
    """Start and end words of a rule's hits, with what is needed to rank them: the hits are put between marks, which the words of the marked text
    then carry."""
    words = F.split(F.trim(F.call_function("regexp_replace", text, rule["pattern"], F.lit("\u0001$0\u0002"))), " ")
    at = lambda marked: F.array_compact(F.transform(words, lambda w, k: F.when(marked(w), k)))
    starts, ends = at(lambda w: F.startswith(w, F.lit("\u0001"))), at(lambda w: F.endswith(w, F.lit("\u0002")))

    def hit(start: Column, last: Column) -> Column:
        return F.struct(start.alias("start"), (-last - 1).alias("behind"), rule["level"].alias("level"), rule["place"].alias("place"), rule["label"].alias("label"), rule["sure"].alias("sure"))

    return F.when(F.call_function("rlike", text, rule["pattern"]), F.zip_with(starts, ends, hit))


def _unsuppressed(found: Column) -> Column:
    """The hits, sorted by start and falling end, that no other suppresses: for each level the farthest end of the hits before, of this level or a better one, is
    a running maximum, made in rounds that look back 1, 2, 4 ... places."""
    ends = F.transform(found, lambda h, k: F.struct(*[F.when(F.get(found, k - 1)["level"] <= level, -F.get(found, k - 1)["behind"]).otherwise(-1).alias(f"l{level}") for level in LEVELS]))

    def back(state: Column, by: Column) -> Column:
        return F.transform(state, lambda x, k: F.struct(*[F.greatest(x[f"l{n}"], F.coalesce(F.get(state, k - by)[f"l{n}"], F.lit(-1))).alias(f"l{n}") for n in LEVELS]))

    rounds = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(found) + 1)).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    farthest = F.aggregate(rounds, ends, back)
    own = F.transform(farthest, lambda x: F.array(*[x[f"l{n}"] for n in LEVELS]))
    kept = F.zip_with(found, own, lambda h, ends: F.when(F.element_at(ends, h["level"]) < -h["behind"], h))
    return F.array_compact(kept)


def with_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``licenses``: n_words, n_base, first_word, last_word, base_labels, labels, score, and the detections (start, end, label, level, sure)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    words = F.concat(F.lit(" "), F.trim(F.translate(words, upper, upper.lower())), F.lit(" "))
    table = df.sparkSession.createDataFrame(_rule_table(), "need string, keyword string, rules array<struct<place:int,pattern:string,label:string,level:int,sure:double>>")
    table = table.groupBy("need").agg(F.collect_list(F.struct("keyword", "rules")).alias("keys"))
    table = table.agg(F.collect_list(F.struct("need", "keys"))).scalar()
    whole = F.col("license_text")
    needed = F.filter("license_rules", lambda g: F.contains(whole, g["need"]))
    keyed = F.flatten(F.transform(needed, lambda g: F.filter(g["keys"], lambda k: F.contains(whole, k["keyword"]))))
    tried = F.flatten(F.transform(keyed, lambda k: k["rules"]))
    df = hold(df, license_text=words).withColumn("license_rules", table)
    df = df.withColumn("license_found", F.sort_array(F.flatten(F.array_compact(F.transform(tried, lambda r: _hits(whole, r))))))
    df = df.withColumn("license_hits", F.when(F.size("license_found") > 0, _unsuppressed(F.col("license_found"))))

    phrases = "|".join(BASE)
    parts = F.split(whole, f"(?<= )(?=(?:{phrases}) )", -1)
    based = whole.rlike(f" (?:{phrases}) ")
    base = F.array_compact(F.array(*[F.when(F.contains(whole, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]))
    kept = F.coalesce("license_hits", F.array().cast(df.schema["license_hits"].dataType))
    labels = F.sort_array(F.array_distinct(F.concat(base, F.transform(kept, lambda h: h["label"]))))
    sure = F.greatest(F.coalesce(F.array_max(F.transform(kept, lambda h: h["sure"])), F.lit(0.0)), F.when(based, F.lit(0.75)).otherwise(F.lit(0.0)))
    fields = [
        F.when(F.length(whole) > 2, _spaces(whole) - 1).otherwise(0).cast("long").alias("n_words"),
        F.when(based, F.size(parts) - 1).otherwise(0).cast("long").alias("n_base"),
        F.when(based, _spaces(F.get(parts, F.lit(0))) - 1).cast("long").alias("first_word"),
        F.when(based, _spaces(whole) - _spaces(F.element_at(parts, -1)) - 1).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        sure.alias("score"),
        F.transform(kept, lambda h: F.struct(h["start"].alias("start"), (-h["behind"]).alias("end"), h["label"].alias("label"), h["level"].alias("level"), h["sure"].alias("sure"))).alias("detections"),
    ]
    return release(settle(df, licenses=F.struct(*fields)), licenses="licenses")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return with_licenses(docs).select("doc_id", *[f"licenses.{n}" for n in names])
