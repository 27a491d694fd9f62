"""License scans by ordered signature rules, in DataFrame functions only.

Hundreds of regular expressions, each behind a keyword that its matches always contain, are tried
on the text, with A-Z folded, in one row, without a shuffle.  Detections are swept in order of start,
longest first: one that lies within an earlier one goes, whatever its priority, and of two that
overlap in part the one of higher priority stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from re import escape
from re._constants import BRANCH, LITERAL, SUBPATTERN
from re._parser import parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters outside words, and within them, before letters are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_IN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_BASE_PATTERN = f"(?i)(?=[cga])(?<!{_IN})(?:" + "|".join(p.replace(" ", f"{_GAP}+") for p in _BASE) + f")(?!{_IN})"


_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def _n_words(text: Column) -> Column:
    """Words of a text: runs of other characters than gaps, which become spaces first, as a
    pattern of one character is several times faster than one of ranges."""
    return F.regexp_count(F.translate(text, _GAPS, " " * len(_GAPS)), F.lit("[^ ]+"))


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches text whose A-Z are lower-cased; every match contains ``keyword`` and one of
    the ``stems``; low ``priority`` wins."""

    label: str
    priority: int
    keyword: str
    pattern: str
    stems: tuple[str, ...] = ()


def stems(pattern: str, keyword: str) -> tuple[str, ...]:
    """Strings of which every match has one: of each branch of the pattern, the longest literal, but
    rather one that says more than the keyword."""

    def literals(parts: list) -> Iterator[str]:
        run = ""
        for op, value in parts:
            if op is LITERAL:
                run += chr(value)
                continue
            yield run
            run = ""
            if op is SUBPATTERN:
                yield from literals(list(value[3]))
        yield run

    branches = [[]]
    for part in list(parse(pattern)):
        inner = list(part[1][3]) if part[0] is SUBPATTERN else [part]
        if len(inner) == 1 and inner[0][0] is BRANCH and len(branches) == 1:
            branches = [branches[0] + list(b) for b in inner[0][1][1]]
        else:
            branches = [b + [part] for b in branches]
    found = [max(literals(b), key=lambda x: (x not in keyword, len(x))) for b in branches]
    return tuple(sorted(set(found))) if all(found) else ()


# Label, SPDX identifier, how texts write the name, where the license lives.
_KNOWN = [
    ("mit", "mit", r"mit|expat", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit-0", r"mit[ -]no[ -]attribution", r"opensource\.org/licenses?/mit-0"),
    ("apache-2.0", "apache-2\\.0", r"apache(?:\s+software)?(?:\s+license)?,?\s+(?:version|v\.?)?\s*2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache-1\\.1", r"apache(?:\s+software)?(?:\s+license)?,?\s+(?:version|v\.?)?\s*1\.1", r"apache\.org/licenses/license-1\.1"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:simplified|freebsd|2-clause|two-clause)\s+bsd|bsd[ -](?:2|two)[ -]clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:new|revised|modified|3-clause|three-clause)\s+bsd|bsd[ -](?:3|three)[ -]clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:original|4-clause|four-clause)\s+bsd|bsd[ -](?:4|four)[ -]clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", "0bsd", r"zero[ -]clause\s+bsd|bsd\s+zero[ -]clause", r"opensource\.org/licenses?/0bsd"),
    ("isc", "isc", r"isc|internet systems consortium", r"opensource\.org/licenses?/isc"),
    ("gpl-1.0", "gpl-1\\.0(?:-only|-or-later|\\+)?", r"gpl[ -]?(?:version\s+|v)?1(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "gpl-2\\.0(?:-only|-or-later|\\+)?", r"gpl[ -]?(?:version\s+|v)?2(?:\.0)?|general public license,?\s+(?:version|v\.?)\s*2", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl-3\\.0(?:-only|-or-later|\\+)?", r"gpl[ -]?(?:version\s+|v)?3(?:\.0)?|general public license,?\s+(?:version|v\.?)\s*3", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.0", "lgpl-2\\.0(?:-only|-or-later|\\+)?", r"lgpl[ -]?(?:version\s+|v)?2(?:\.0)?|library general public license,?\s+(?:version|v\.?)\s*2", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "lgpl-2\\.1(?:-only|-or-later|\\+)?", r"lgpl[ -]?(?:version\s+|v)?2\.1|lesser general public license,?\s+(?:version|v\.?)\s*2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl-3\\.0(?:-only|-or-later|\\+)?", r"lgpl[ -]?(?:version\s+|v)?3(?:\.0)?|lesser general public license,?\s+(?:version|v\.?)\s*3", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "agpl-3\\.0(?:-only|-or-later|\\+)?", r"agpl[ -]?(?:version\s+|v)?3?(?:\.0)?|affero general public", r"gnu\.org/licenses/agpl"),
    ("gfdl", "gfdl-1\\.[123](?:-\\w+)*", r"gnu free documentation|gfdl", r"gnu\.org/licenses/fdl"),
    ("mpl-1.1", "mpl-1\\.1", r"mpl[ -]?(?:version\s+|v)?1\.1|mozilla public license,?\s+(?:version|v\.?)?\s*1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mpl-2\\.0", r"mpl[ -]?(?:version\s+|v)?2(?:\.0)?|mozilla public license,?\s+(?:version|v\.?)?\s*2(?:\.0)?", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", "epl-1\\.0", r"epl[ -]?(?:version\s+|v)?1(?:\.0)?|eclipse public license(?:,?\s+(?:version|v\.?)?\s*1(?:\.0)?)", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl-2\\.0", r"epl[ -]?(?:version\s+|v)?2(?:\.0)?|eclipse public license(?:,?\s+(?:version|v\.?)?\s*2(?:\.0)?)", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl-1.0", "cddl-1\\.0", r"cddl|common development and distribution", r"opensource\.org/licenses?/cddl"),
    ("cpl-1.0", "cpl-1\\.0", r"common public", r"opensource\.org/licenses?/cpl"),
    ("eupl", "eupl-1\\.[012]", r"eupl|european union public", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("artistic-1.0", "artistic-1\\.0(?:-perl|-cl8)?", r"artistic(?:\s+license)?,?\s+(?:version|v\.?)?\s*1(?:\.0)?", r"opensource\.org/licenses?/artistic-1"),
    ("artistic-2.0", "artistic-2\\.0", r"artistic(?:\s+license)?,?\s+(?:version|v\.?)?\s*2(?:\.0)?", r"opensource\.org/licenses?/artistic-2"),
    ("boost-1.0", "bsl-1\\.0", r"boost(?:\s+software)?", r"boost\.org/license_1_0"),
    ("bsl-1.1", "busl-1\\.1", r"business source", r"mariadb\.com/bsl11"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"zlib\.net/zlib_license"),
    ("libpng", "libpng(?:-2\\.0)?", r"libpng", r"libpng\.org/pub/png/src/libpng-license"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl|do what the fuck you want to public", r"wtfpl\.net"),
    ("psf-2.0", "psf-2\\.0|python-2\\.0", r"python software foundation|psf", r"python\.org/psf/license"),
    ("ruby", "ruby", r"ruby(?:'s)?", r"ruby-lang\.org/\S*license"),
    ("php-3.01", "php-3\\.01?", r"php(?:\s+license)?,?\s+(?:version|v\.?)?\s*3\.0?1?", r"php\.net/license"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql\.org/about/licen[sc]e"),
    ("openssl", "openssl", r"openssl", r"openssl\.org/source/license"),
    ("curl", "curl", r"curl", r"curl\.se/docs/copyright"),
    ("ncsa", "ncsa", r"ncsa|university of illinois", r"opensource\.org/licenses?/ncsa"),
    ("ofl-1.1", "ofl-1\\.1(?:-\\w+)*", r"sil open font|open font", r"scripts\.sil\.org/ofl"),
    ("afl-3.0", "afl-3\\.0", r"academic free", r"opensource\.org/licenses?/afl"),
    ("osl-3.0", "osl-3\\.0", r"open software", r"opensource\.org/licenses?/osl"),
    ("ms-pl", "ms-pl", r"ms-pl|microsoft public", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "ms-rl", r"ms-rl|microsoft reciprocal", r"opensource\.org/licenses?/ms-rl"),
    ("apsl-2.0", "apsl-2\\.0", r"apple public source", r"opensource\.apple\.com/apsl"),
    ("upl-1.0", "upl-1\\.0", r"universal permissive", r"opensource\.org/licenses?/upl"),
    ("vim", "vim", r"vim", r"vimhelp\.org/uganda"),
    ("w3c", "w3c(?:-\\d+)?", r"w3c(?:\s+software(?:\s+notice)?)?", r"w3\.org/consortium/legal"),
    ("ijg", "ijg", r"independent jpeg group", r"spdx\.org/licenses/ijg"),
    ("mulan-2.0", "mulanpsl-2\\.0", r"mulan(?:\s+permissive)?(?:\s+software)?", r"license\.coscl\.org\.cn/mulanpsl2"),
    ("odbl-1.0", "odbl-1\\.0", r"open database|odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "odc-by-1\\.0", r"open data commons attribution|odc-by", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "pddl-1\\.0", r"public domain dedication and", r"opendatacommons\.org/licenses/pddl"),
    ("sspl-1.0", "sspl-1\\.0", r"server side public|sspl", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic-2\\.0", r"elastic", r"elastic\.co/licensing/elastic-license"),
    ("polyform", "polyform-[a-z-]+-1\\.0\\.0", r"polyform", r"polyformproject\.org/licenses"),
    ("openrail", "(?:big)?(?:code-)?openrail-?m?", r"(?:creativeml )?open\s?rail(?:-?m|\+\+)?", r"licenses\.ai"),
]
_COMMONS = [("by", "attribution"), ("by-sa", "attribution[- ]share[- ]?alike"), ("by-nd", "attribution[- ]no[- ]?deriv\\w*"), ("by-nc", "attribution[- ]non[- ]?commercial"), ("by-nc-sa", "attribution[- ]non[- ]?commercial[- ]share[- ]?alike"), ("by-nc-nd", "attribution[- ]non[- ]?commercial[- ]no[- ]?deriv\\w*")]
_SINGLE = [
    Rule("gpl", 60, "gnu", r"\bgnu\s+general\s+public\b"),
    Rule("lgpl", 55, "gnu", r"\bgnu\s+(?:lesser|library)\s+general\s+public\b"),
    Rule("agpl-3.0", 55, "gnu", r"\bgnu\s+affero\b"),
    Rule("gpl", 62, "licen", r"\blicen[sc]ed\s+under\s+(?:the\s+)?gpl\b"),
    Rule("cc0-1.0", 20, "licen", r"spdx-license-identifier:\s*cc0-1\.0"),
    Rule("cc0-1.0", 30, "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0"),
    Rule("cc0-1.0", 40, "creative commons", r"\bcreative commons (?:zero|cc0|0)\b"),
    Rule("public-domain", 70, "public domain", r"\b(?:in|into|to)\s+the\s+public domain\b"),
    Rule("public-domain", 72, "public domain", r"\bpublic domain\b"),
    Rule("cc-by", 64, "licen", r"\bcc[ -]by\s+licen[sc]e\b"),
    Rule("creative-commons", 80, "creative commons", r"\bcreative commons\b"),
    Rule("mit", 35, "permission", r"\bpermission is hereby granted, free of charge, to any person obtaining a copy\b"),
    Rule("isc", 36, "permission", r"\bpermission to use, copy, modify, and(?:/or)? distribute this software for any purpose\b"),
    Rule("bsd", 37, "redistribut", r"\bredistribution and use in source and binary forms\b"),
    Rule("bsd-3-clause", 34, "permission", r"\bmay not? be used to endorse or promote products .{0,80}\bwithout specific prior written permission\b"),
    Rule("boost-1.0", 34, "permission", r"\bpermission is hereby granted, free of charge, to any person or organization\b"),
    Rule("zlib", 34, "warrant", r"\bprovided 'as-is', without any express or implied warranty\b"),
    Rule("warranty-disclaimer", 85, "warrant", r"\bwithout warrant(?:y|ies) of any kind\b"),
    Rule("warranty-disclaimer", 86, "warrant", r"\bwarranties of merchantability\b"),
    Rule("copyright", 90, "copyright", r"\bcopyright\s+(?:\(c\)\s*|©\s*)?(?:19|20)\d\d\b"),
    Rule("copyright", 91, "copyright", r"\bcopyright\s+(?:\(c\)|©)"),
    Rule("copyright", 92, "copyright", r"\ball\s+copyrights?\b"),
    Rule("reserved", 88, "rights reserved", r"\b(?:all|some)\s+rights reserved\b"),
    Rule("proprietary", 75, "licen", r"\b(?:proprietary|commercial|end[- ]user)\s+licen[sc]e\b"),
    Rule("copyleft", 89, "copyleft", r"\bcopyleft\b"),
    Rule("other", 95, "licen", r"\blicen[sc]ed?\s+(?:under|agreement|terms)\b"),
    Rule("other", 96, "licen", r"\bopen[- ]source\s+licen[sc]e\b"),
    Rule("other", 97, "spdx", r"\bspdx-license-identifier:\s*[a-z0-9.+-]+"),
]
# Label, keyword, and a sentence of the license's text or of the notice that it asks for.
_BODIES = [
    ("apache-2.0", "licen", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an"),
    ("apache-2.0", "licen", "subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide"),
    ("gpl-2.0", "licen", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "licen", "the licenses for most software and other practical works are designed to take away your freedom"),
    ("gpl-3.0", "gnu", "the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl", "gnu", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-2.0", "gnu", "it under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", "licen", "this license, the lesser general public license, applies to some specially designated software packages"),
    ("lgpl-3.0", "gnu", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", "gnu", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", "gnu", "the gnu affero general public license is a free, copyleft license for software and other kinds of works"),
    ("mpl-1.1", "licen", "the contents of this file are subject to the mozilla public license version 1.1"),
    ("mpl-2.0", "licen", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("epl", "licen", "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-1.0", "licen", "made available under the terms of the eclipse public license v1.0"),
    ("epl-2.0", "licen", "made available under the terms of the eclipse public license 2.0"),
    ("cddl-1.0", "licen", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
]


def rules() -> list[Rule]:
    """All rules in order of priority: tag, text, place and name of each known license, then the rest.
    A text's sentence may be broken over lines at any space."""
    out = _SINGLE + [Rule(label, 25, keyword, r"\b" + escape(sentence).replace(r"\ ", r"\s+") + r"\b") for label, keyword, sentence in _BODIES]
    for label, spdx, name, place in _KNOWN:
        out += [
            Rule(label, 20, "spdx", rf"spdx-license-identifier:\s*\(?(?:{spdx})(?![\w.-])"),
            Rule(label, 30, "licen" if "licen" in place else place.split("\\")[0].split("[")[0], rf"\b{place}\b"),
            Rule(label, 40, "licen", rf"\blicen[sc]ed?\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:{name})\b"),
            Rule(label, 45, "licen", rf"\b(?:{name})\s+(?:public\s+)?licen[sc]e\b"),
        ]
    for short, long in _COMMONS:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = version.replace(".", r"\.")
            out += [
                Rule(f"cc-{short}-{version}", 20, "spdx", rf"spdx-license-identifier:\s*cc-{short}-{v}(?![\w.-])"),
                Rule(f"cc-{short}-{version}", 30, "creativecommons", rf"creativecommons\.org/licenses/{short}/{v}"),
                Rule(f"cc-{short}-{version}", 42, "creative commons", rf"\bcreative commons {long}\s+(?:international\s+|unported\s+|generic\s+)?{v}"),
                Rule(f"cc-{short}-{version}", 43, "cc", rf"\bcc[ -]{short.replace('-', '[ -]')}[ -]{v}\b"),
            ]
    return sorted((replace(r, pattern=_bounded(r.pattern), stems=stems(r.pattern, r.keyword)) for r in out), key=lambda r: (r.priority, r.label, r.pattern))


def _bounded(pattern: str) -> str:
    r"""Word boundaries (\b) at the ends as looks for A-Z, digits and underscores, as Java's \b
    differs between versions beside other letters."""
    if pattern.startswith(r"\b"):
        pattern = "(?<![a-z0-9_])" + pattern[2:]
    return pattern.replace(r"\b", "(?![a-z0-9_])")


def _spans(text: Column, rule: Column) -> Column:
    """(start, -end, priority, label) of each match of a rule."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    between = F.split(text, rule["pattern"], -1)
    step = F.transform(found, lambda m, i: F.struct(F.char_length(F.get(between, i)).alias("gap"), F.char_length(m).alias("size")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,neg_end:int,priority:int,label:string>>)").alias("out"))
    return F.aggregate(step, zero, lambda acc, s: F.struct((acc["at"] + s["gap"] + s["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (-(acc["at"] + s["gap"] + s["size"])).alias("neg_end"), rule["priority"].alias("priority"), rule["label"].alias("label")))).alias("out")), lambda acc: acc["out"])


def _sweep(hits: Column) -> Column:
    """Labels and number of the detections that stay; ``hits`` are in order of start, longest first."""
    zero = F.expr("named_struct('start', -1, 'end', -1, 'priority', 0, 'label', cast(null as string), 'labels', cast(array() as array<string>), 'n', 0)")

    def state(s: Column, e: Column, p: Column, label: Column, labels: Column, n: Column) -> Column:
        return F.struct(s.alias("start"), e.alias("end"), p.alias("priority"), label.alias("label"), labels.alias("labels"), n.alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = -h["neg_end"]
        inside, apart = end <= acc["end"], h["start"] >= acc["end"]
        kept = F.when(acc["label"].isNull(), acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(acc["label"])))
        take = state(h["start"], end, h["priority"], h["label"], acc["labels"], acc["n"])
        return F.when(apart, state(h["start"], end, h["priority"], h["label"], kept, acc["n"] + acc["label"].isNotNull().cast("int"))).when(~inside & (h["priority"] < acc["priority"]), take).otherwise(acc)

    last = F.aggregate(hits, zero, step)
    return F.when(last["label"].isNull(), F.struct(F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0).alias("n"))).otherwise(
        F.struct(F.array_union(last["labels"], F.array(last["label"])).alias("labels"), (last["n"] + 1).alias("n")))


def detections(text: Column, lower: Column, signatures: list[Rule]) -> Column:
    """All matches of the rules whose keyword the lower-cased text contains, sorted for the sweep.

    ``lower`` may have more letters lower-cased than A-Z, as it only holds more keywords then; the
    patterns fold A-Z alone."""
    tree: dict[str, dict[tuple[str, ...], list[Rule]]] = {}
    for r in signatures:
        tree.setdefault(r.keyword, {}).setdefault(r.stems or (r.keyword,), []).append(r)

    def node(r: Rule) -> Column:
        return F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit("(?i)" + r.pattern).alias("pattern"))

    def group(some: tuple[str, ...], own: list[Rule]) -> Column:
        return F.struct(F.array(*map(F.lit, some)).alias("stems"), F.array(*map(node, own)).alias("rules"))

    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*[group(*g) for g in own.items()]).alias("groups")) for k, own in tree.items()])
    open_ = F.flatten(F.transform(F.filter(table, lambda t: F.contains(lower, t["keyword"])), lambda t: t["groups"]))
    gated = F.flatten(F.transform(F.filter(open_, lambda g: F.exists(g["stems"], lambda x: F.contains(lower, x))), lambda g: g["rules"]))
    return F.array_sort(F.flatten(F.transform(F.filter(gated, lambda r: F.rlike(text, r["pattern"])), lambda r: _spans(text, r))))


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """Query op8: one row per row of ``docs``, whole texts, no shuffle.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found.  The
    score is 1 - 2^-(base places + detections).  Null texts are empty; without detections the
    labels are empty strings; repeated rows are scanned each; other columns are ignored.
    """
    signatures = signatures or rules()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("l_text")).withColumn("l_lower", F.lower("l_text"))
    stems = sorted({r.keyword for r in signatures if r.keyword != "cc"})
    some = F.lit(False)
    for stem in stems:
        some = some | F.contains("l_lower", F.lit(stem))
    if any(r.keyword == "cc" for r in signatures):
        some = some | F.col("l_lower").rlike(r"\bcc[ -]by[ -]")
    rows = rows.withColumn("l_base", F.col("l_text").rlike(_BASE_PATTERN)).withColumn("l_some", some)
    n_words = _n_words(F.col("l_text"))
    found = F.when(F.col("l_base"), F.regexp_extract_all("l_text", F.lit(_BASE_PATTERN), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    between = F.when(F.col("l_base"), F.split("l_text", _BASE_PATTERN, -1))
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), "l_text", "l_lower", "l_some", found.alias("l_found"), between.alias("l_between"))
    label = F.transform("l_found", lambda m: F.when(F.lower(F.substring(m, 1, 1)) == "c", "cc-by").when(F.lower(F.substring(m, 1, 1)) == "g", "gpl").otherwise("reserved"))
    after = _n_words(F.element_at("l_between", -1))
    final = F.when(F.element_at(label, -1) == "cc-by", 2).otherwise(3)
    rows = rows.select(
        "doc_id", "n_words", F.size("l_found").cast("long").alias("n_base"),
        F.when(F.size("l_found") > 0, _n_words(F.element_at("l_between", 1))).cast("long").alias("first_word"),
        F.when(F.size("l_found") > 0, F.col("n_words") - after - final).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(label)).alias("l_labels"),
        F.when(F.col("l_some"), detections(F.col("l_text"), F.col("l_lower"), signatures)).otherwise(F.expr("cast(array() as array<struct<start:int,neg_end:int,priority:int,label:string>>)")).alias("l_hits"))
    rows = rows.withColumn("l_kept", _sweep(F.col("l_hits")))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("l_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("l_labels", F.col("l_kept")["labels"])), ",").alias("labels"),
        (1 - F.pow(F.lit(0.5), F.col("n_base") + F.col("l_kept")["n"])).alias("score"), F.col("l_kept")["n"].alias("n_found"))
