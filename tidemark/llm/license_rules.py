"""Signature rules of the license scan, from a list of licenses and the forms in which texts cite them.

A rule is (contexts, keywords, tier, label, pattern). Patterns run over lower-case words joined by one space.
Every match of a pattern holds one of the contexts and one of the keywords, so a text without them needs no run of it.
Tiers: 1 an identifier line or a sentence of the license's own text, 2 a named grant, 3 a bare mention.
"""

from __future__ import annotations

#: Base phrases; fixed values.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

TIER_SCORE = {1: 1.0, 2: 0.9, 3: 0.5}

#: label -> (keywords of which every identifier and name holds one, pattern of its identifier in words, pattern of its name)
LICENSES: dict[str, tuple[str, str, str]] = {
    "mit": ("mit|expat", r"mit", r"(?:mit|expat)(?: x11)?"),
    "mit-0": ("mit", r"mit 0", r"mit no attribution"),
    "apache-1.1": ("apache", r"apache 1 1", r"apache(?: software)? license(?: version)? 1 1"),
    "apache-2.0": ("apache", r"apache 2 0", r"apache(?: software)? license(?: version)? 2(?: 0)?"),
    "gpl-1.0": ("gpl", r"gpl 1 0(?: only| or later)?", r"gpl ?v?1"),
    "gpl-2.0": ("gpl", r"gpl 2 0(?: only| or later)?", r"gpl ?v?2"),
    "gpl-3.0": ("gpl", r"gpl 3 0(?: only| or later)?", r"gpl ?v?3"),
    "gnu-gpl-2": ("gnu gpl|general public", r"gnu gpl 2", r"(?:gnu )?general public license (?:version|v) ?2"),
    "gnu-gpl-3": ("gnu gpl|general public", r"gnu gpl 3", r"(?:gnu )?general public license (?:version|v) ?3"),
    "lgpl": ("gnu lgpl|lesser", r"gnu lgpl", r"(?:gnu )?lesser general public license"),
    "lgpl-library": ("library", r"gnu library", r"(?:gnu )?library general public license"),
    "lgpl-2.1": ("lgpl", r"lgpl 2 1(?: only| or later)?", r"lgpl ?v?2(?: 1)?"),
    "lgpl-3.0": ("lgpl", r"lgpl 3 0(?: only| or later)?", r"lgpl ?v?3"),
    "agpl": ("affero", r"gnu affero", r"(?:gnu )?affero general public license"),
    "agpl-3.0": ("agpl", r"agpl 3 0(?: only| or later)?", r"agpl ?v?3"),
    "gfdl": ("gfdl|documentation", r"gfdl 1 [123]", r"(?:gnu )?free documentation license"),
    "bsd-2-clause": ("bsd", r"bsd 2 clause", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause"),
    "bsd-3-clause": ("bsd", r"bsd 3 clause", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause"),
    "bsd-4-clause": ("bsd", r"bsd 4 clause", r"(?:original|4 clause|four clause) bsd|bsd 4 clause"),
    "bsd": ("bsd", r"bsd", r"bsd(?: style| type)?"),
    "0bsd": ("bsd", r"0bsd", r"(?:zero clause|0) ?bsd"),
    "isc": ("isc", r"isc", r"isc"),
    "mpl-1.1": ("mpl", r"mpl 1 1", r"mpl ?v?1 1"),
    "mpl-2.0": ("mpl", r"mpl 2 0", r"mpl ?v?2(?: 0)?"),
    "mpl": ("mozilla", r"mozilla public", r"mozilla public license(?: version [12] [01])?"),
    "epl-1.0": ("epl", r"epl 1 0", r"epl ?v?1(?: 0)?"),
    "epl-2.0": ("epl", r"epl 2 0", r"epl ?v?2(?: 0)?"),
    "epl": ("eclipse", r"eclipse public", r"eclipse public license"),
    "edl": ("edl|eclipse", r"edl 1 0", r"eclipse distribution license"),
    "eupl": ("eupl", r"eupl 1 [12]", r"eupl"),
    "eupl-named": ("european", r"european union public", r"european union public licen[cs]e"),
    "cddl": ("cddl", r"cddl 1 [01]", r"cddl"),
    "cddl-named": ("common development", r"common development", r"common development and distribution license"),
    "cpl": ("cpl|common public", r"cpl 1 0", r"common public license"),
    "artistic-1.0": ("artistic", r"artistic 1 0", r"artistic license 1(?: 0)?"),
    "artistic-2.0": ("artistic", r"artistic 2 0", r"artistic license 2(?: 0)?"),
    "artistic": ("artistic", r"artistic", r"artistic"),
    "zlib": ("zlib", r"zlib", r"zlib(?: libpng)?"),
    "libpng": ("libpng", r"libpng", r"libpng"),
    "boost": ("bsl|boost", r"bsl 1 0", r"boost software license"),
    "unlicense": ("unlicense", r"unlicense", r"(?:the )?unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl", r"wtfpl"),
    "cc0": ("cc0", r"cc0 1 0", r"cc0"),
    "cc-by": ("cc by", r"cc by [1234] [05]", r"cc by"),
    "cc-by-sa": ("cc by", r"cc by sa [1234] [05]", r"cc by sa"),
    "cc-by-nc": ("cc by", r"cc by nc [1234] [05]", r"cc by nc"),
    "cc-by-nd": ("cc by", r"cc by nd [1234] [05]", r"cc by nd"),
    "cc-by-nc-sa": ("cc by", r"cc by nc sa [1234] [05]", r"cc by nc sa"),
    "cc-by-nc-nd": ("cc by", r"cc by nc nd [1234] [05]", r"cc by nc nd"),
    "cc-attribution": ("creative", r"creative commons attribution", r"creative commons attribution(?: [1234] [05])?"),
    "cc-sharealike": ("creative", r"creative commons sharealike", r"creative commons (?:attribution )?share ?alike"),
    "cc-zero": ("creative", r"creative commons zero", r"creative commons zero"),
    "ofl": ("ofl", r"ofl 1 [01]", r"sil ofl|ofl"),
    "ofl-named": ("open font", r"open font", r"(?:sil )?open font license"),
    "odbl": ("odbl", r"odbl 1 0", r"odbl"),
    "odbl-named": ("open database", r"open database", r"open database license"),
    "ms-pl": ("ms pl|microsoft", r"ms pl", r"microsoft public license"),
    "ms-rl": ("ms rl|microsoft", r"ms rl", r"microsoft reciprocal license"),
    "python": ("psf|python", r"psf 2 0|python 2 0", r"python(?: software foundation)?"),
    "php": ("php", r"php 3 0(?:1)?", r"php"),
    "ruby": ("ruby", r"ruby", r"ruby"),
    "perl": ("perl", r"perl", r"perl"),
    "postgresql": ("postgresql", r"postgresql", r"postgresql"),
    "openssl": ("openssl", r"openssl", r"openssl"),
    "w3c": ("w3c", r"w3c", r"w3c(?: software notice and)?"),
    "x11": ("x11", r"x11", r"x11"),
    "ncsa": ("ncsa", r"ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    "afl": ("afl|academic", r"afl 3 0", r"academic free license"),
    "osl": ("osl|open software", r"osl 3 0", r"open software license"),
    "qpl": ("qpl|q public", r"qpl 1 0", r"q public license|qpl"),
    "sspl": ("sspl|server side", r"sspl 1 0", r"server side public license|sspl"),
    "busl": ("busl|business source", r"busl 1 1", r"business source license"),
    "elastic": ("elastic", r"elastic 2 0", r"elastic license"),
    "unicode": ("unicode", r"unicode dfs 201[56]", r"unicode"),
    "upl": ("upl|universal permissive", r"upl 1 0", r"universal permissive license|upl"),
    "vim": ("vim", r"vim", r"vim"),
    "beerware": ("beerware|beer ware", r"beerware", r"beer ?ware"),
    "json": ("json", r"json", r"json"),
    "intel": ("intel", r"intel", r"intel(?: open source)?"),
    "ipl": ("ipl|ibm", r"ipl 1 0", r"ibm public license"),
    "sleepycat": ("sleepycat", r"sleepycat", r"sleepycat"),
}

#: names that are enough without the word license
BARE = ("qpl", "sspl", "upl")
UNDER = ("released under", "distributed under", "available under", "published under", "provided under")

#: (contexts, tier, form); {id} and {name} are filled in for every license
FORMS = [
    (("spdx license identifier",), 1, r"\bspdx license identifier (?:{id})\b"),
    (("licensed",), 2, r"\b(?:re)?licensed (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[sc]e)?\b"),
    (UNDER, 2, r"\b(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[sc]e)?\b"),
    (("licen",), 3, r"\b(?:{name}) licen[sc]ed?\b"),
]

#: Sentences of license texts and notices that name no license: (keyword, tier, label, pattern)
SENTENCES = [
    ("permission is hereby granted", 1, "mit", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"),
    ("permission to use copy modify", 1, "isc", r"\bpermission to use copy modify and (?:or )?distribute this software for any purpose\b"),
    ("redistribution and use in source", 1, "bsd", r"\bredistribution and use in source and binary forms with or without modification are permitted\b"),
    ("you can redistribute it", 1, "gpl", r"\byou can redistribute it and or modify it under the terms of the gnu\b"),
    ("neither the name of", 1, "bsd-3-clause", r"\bneither the name of .{1,80}? nor the names of its contributors\b"),
    ("public domain", 2, "public-domain", r"\b(?:released|placed|dedicated) (?:in ?to|to|in) the public domain\b"),
    ("public domain", 3, "public-domain", r"\bpublic domain\b"),
    ("all rights reserved", 3, "all-rights-reserved", r"\ball rights reserved\b"),
    ("copyright", 3, "copyright", r"\bcopyright (?:c )?(?:19|20)[0-9]{{2}}\b".replace("{{", "{").replace("}}", "}")),
    ("without warranty", 3, "no-warranty", r"\bwithout warranty of any kind\b"),
    ("proprietary and confidential", 3, "proprietary", r"\bproprietary and confidential\b"),
]

RULES: list[tuple[tuple[str, ...], tuple[str, ...], int, str, str]] = [
    *[((keyword,), (keyword,), tier, label, pattern) for keyword, tier, label, pattern in SENTENCES],
    *[(contexts, tuple(keywords.split("|")), tier, label, form.format(id=ident, name=name)) for contexts, tier, form in FORMS for label, (keywords, ident, name) in LICENSES.items()],
    # names that hold the word themselves are enough
    *[(("licen", *[b for b in BARE if b in keywords.split("|")]), tuple(keywords.split("|")), 2, label, rf"\b(?:{name})\b") for label, (keywords, _, name) in LICENSES.items() if "licen" in name],
    (("gnu gpl",), ("gnu gpl",), 3, "gpl", r"\bgnu gpl\b"),
    (("licensed",), ("gpl",), 2, "gpl", r"\blicensed under (?:the )?(?:gnu )?gpl\b"),
    (("licen",), ("general public",), 2, "gpl", r"\b(?:gnu )?general public license\b"),
    (("licen",), ("mit",), 2, "mit", r"\bmit license\b"),
    (("licen",), ("apache",), 2, "apache", r"\bapache license\b"),
]
