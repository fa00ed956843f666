"""License detection by ordered signature rules, with DataFrame functions only.

A text that no rule can match, by a gate made from the rules, is done. For the others each rule whose own keywords all
occur is matched; detections carry the place, the label, the rule's priority and its weight. Sorted by place, they are resolved in one
pass: a detection inside a longer one that stays is suppressed, of two that overlap in part the higher priority
stays, and what only a suppressed one would have suppressed stays as well. Everything is a projection: no row is multiplied, nothing is shuffled, no Python runs on the executors.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import require

#: Words are runs of ASCII letters and digits and of non-ASCII characters (A-Z counts as a-z). Fixed values of the contract.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

# Signature rules, by hand: label: (keyword, [name patterns], [identifiers], [addresses]). "_" stands for blanks or hyphens,
# "V(2)" for a version "2", "2.0", "v2", "version 2" and the like.
SIGNATURES: dict[str, tuple[str, list[str], list[str], list[str]]] = {
    "agpl-3.0": ("affero", [r"gnu_affero_general_public_licen[sc]e(?:,?_V(3))?", r"affero_gpl_V(3)", r"affero_general_public_licen[sc]e"], ["AGPL-3.0(?:-only|-or-later)?", "AGPLv3"], [r"gnu\.org/licenses/agpl"]),
    "gpl-1.0": ("gnu", [r"gnu_general_public_licen[sc]e,?_V(1)", r"gnu_gpl_V(1)"], ["GPL-1.0(?:-only|-or-later|\\+)?"], [r"gnu\.org/licenses/old-licenses/gpl-1"]),
    "gpl-2.0": ("gnu", [r"gnu_general_public_licen[sc]e,?_V(2)", r"gnu_gpl_V(2)"], ["GPL-2.0(?:-only|-or-later|\\+)?", "GPLv2"], [r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"]),
    "gpl-3.0": ("gnu", [r"gnu_general_public_licen[sc]e,?_V(3)", r"gnu_gpl_V(3)"], ["GPL-3.0(?:-only|-or-later|\\+)?", "GPLv3"], [r"gnu\.org/licenses/gpl-3", r"gnu\.org/licenses/gpl(?:\.html|\.txt)?"]),
    "lgpl-2.1": ("lesser", [r"gnu_lesser_general_public_licen[sc]e,?_V(2\.1)", r"lesser_gpl_V(2\.1)", r"gnu_library_general_public_licen[sc]e"], ["LGPL-2.1(?:-only|-or-later|\\+)?", "LGPLv2\\.1"], [r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2"]),
    "lgpl-3.0": ("lesser", [r"gnu_lesser_general_public_licen[sc]e(?:,?_V(3))?", r"lesser_gpl(?:_V(3))?"], ["LGPL-3.0(?:-only|-or-later|\\+)?", "LGPLv3"], [r"gnu\.org/licenses/lgpl"]),
    "gfdl-1.3": ("documentation", [r"gnu_free_documentation_licen[sc]e(?:,?_V(1\.[123]))?"], ["GFDL-1\\.[123](?:-only|-or-later)?"], [r"gnu\.org/licenses/fdl"]),
    "apache-1.1": ("apache", [r"apache_software_licen[sc]e,?_V(1\.1)", r"apache_licen[sc]e,?_V(1\.1)"], ["Apache-1\\.1"], [r"apache\.org/licenses/license-1\.1"]),
    "apache-2.0": ("apache", [r"apache_licen[sc]e,?_V(2)", r"apache_software_licen[sc]e,?_V(2)", r"apache_V(2)_licen[sc]e", r"asl_V(2)"], ["Apache-2\\.0"], [r"apache\.org/licenses/license-2\.0"]),
    "mit": ("mit", [r"(?:the_)?mit_licen[sc]e", r"licen[sc]ed_under_(?:the_)?mit", r"mit/x11", r"expat_licen[sc]e"], ["MIT"], [r"opensource\.org/licen[sc]es?/mit"]),
    "mit-0": ("mit", [r"mit_no_attribution"], ["MIT-0"], [r"opensource\.org/licen[sc]es?/mit-0"]),
    "bsd-2-clause": ("bsd", [r"(?:2_clause|two_clause|simplified|freebsd)_(?:bsd_)?licen[sc]e", r"bsd_2_clause", r"simplified_bsd"], ["BSD-2-Clause"], [r"opensource\.org/licen[sc]es?/bsd-2"]),
    "bsd-3-clause": ("bsd", [r"(?:3_clause|three_clause|new|modified|revised)_bsd(?:_licen[sc]e)?", r"bsd_3_clause"], ["BSD-3-Clause"], [r"opensource\.org/licen[sc]es?/bsd-3"]),
    "bsd-4-clause": ("bsd", [r"(?:4_clause|four_clause|original|old)_bsd(?:_licen[sc]e)?", r"bsd_4_clause"], ["BSD-4-Clause"], [r"spdx\.org/licenses/bsd-4"]),
    "bsd": ("bsd", [r"bsd_licen[sc]e", r"bsd_style_licen[sc]e", r"berkeley_software_distribution"], ["BSD"], [r"opensource\.org/licen[sc]es?/bsd"]),
    "0bsd": ("bsd", [r"zero_clause_bsd", r"bsd_zero_clause"], ["0BSD"], [r"opensource\.org/licen[sc]es?/0bsd"]),
    "isc": ("isc", [r"isc_licen[sc]e", r"internet_systems_consortium_licen[sc]e"], ["ISC"], [r"opensource\.org/licen[sc]es?/isc"]),
    "mpl-1.1": ("mozilla", [r"mozilla_public_licen[sc]e,?_V(1\.1)", r"mpl_V(1\.1)"], ["MPL-1\\.1"], [r"mozilla\.org/mpl/mpl-1\.1"]),
    "mpl-2.0": ("mozilla", [r"mozilla_public_licen[sc]e(?:,?_V(2))?", r"mpl_V(2)"], ["MPL-2\\.0"], [r"mozilla\.org/(?:en-us/)?mpl/2\.0"]),
    "epl-1.0": ("eclipse", [r"eclipse_public_licen[sc]e,?(?:_|_?-_?)V(1)"], ["EPL-1\\.0"], [r"eclipse\.org/legal/epl-v10"]),
    "epl-2.0": ("eclipse", [r"eclipse_public_licen[sc]e(?:,?(?:_|_?-_?)V(2))?", r"eclipse_distribution_licen[sc]e"], ["EPL-2\\.0"], [r"eclipse\.org/legal/epl-(?:v20|2\.0)"]),
    "cddl-1.0": ("distribution", [r"common_development_and_distribution_licen[sc]e(?:,?_V(1\.[01]))?"], ["CDDL-1\\.[01]"], [r"opensource\.org/licen[sc]es?/cddl"]),
    "cpl-1.0": ("common", [r"common_public_licen[sc]e(?:,?_V(1))?", r"ibm_public_licen[sc]e"], ["CPL-1\\.0"], [r"opensource\.org/licen[sc]es?/cpl"]),
    "artistic-1.0": ("artistic", [r"artistic_licen[sc]e,?_V(1)", r"perl_artistic_licen[sc]e"], ["Artistic-1\\.0(?:-Perl)?"], [r"opensource\.org/licen[sc]es?/artistic-licen[sc]e-1"]),
    "artistic-2.0": ("artistic", [r"artistic_licen[sc]e(?:,?_V(2))?"], ["Artistic-2\\.0"], [r"opensource\.org/licen[sc]es?/artistic-licen[sc]e-2"]),
    "boost-1.0": ("boost", [r"boost_software_licen[sc]e(?:_?-?_?V(1))?"], ["BSL-1\\.0"], [r"boost\.org/license_1_0"]),
    "busl-1.1": ("business", [r"business_source_licen[sc]e(?:,?_V(1\.1))?"], ["BUSL-1\\.1"], [r"mariadb\.com/bsl11"]),
    "elastic-2.0": ("elastic", [r"elastic_licen[sc]e(?:,?_V(2))?"], ["Elastic-2\\.0"], [r"elastic\.co/licensing/elastic-license"]),
    "sspl-1.0": ("server", [r"server_side_public_licen[sc]e(?:,?_V(1))?"], ["SSPL-1\\.0"], [r"mongodb\.com/licensing/server-side-public-license"]),
    "unlicense": ("unlicense", [r"(?:the_)?unlicense"], ["Unlicense"], [r"unlicense\.org"]),
    "wtfpl": ("want", [r"do_what_the_fuck_you_want_to_public_licen[sc]e", r"do_what_the_f\S{0,8}_you_want_to"], ["WTFPL"], [r"wtfpl\.net"]),
    "zlib": ("zlib", [r"zlib_licen[sc]e", r"zlib/libpng_licen[sc]e"], ["Zlib"], [r"opensource\.org/licen[sc]es?/zlib"]),
    "libpng": ("libpng", [r"libpng_licen[sc]e"], ["libpng-2\\.0", "Libpng"], [r"libpng\.org/pub/png/src/libpng-license"]),
    "openssl": ("openssl", [r"openssl_licen[sc]e", r"ssleay_licen[sc]e"], ["OpenSSL"], [r"openssl\.org/source/license"]),
    "python-2.0": ("python", [r"python_software_foundation_licen[sc]e(?:,?_V(2))?", r"psf_licen[sc]e"], ["PSF-2\\.0", "Python-2\\.0"], [r"docs\.python\.org/3/license"]),
    "php-3.01": ("php", [r"php_licen[sc]e(?:,?_V(3\.01?))?"], ["PHP-3\\.01?"], [r"php\.net/license"]),
    "ruby": ("ruby", [r"ruby_licen[sc]e", r"ruby's_licen[sc]e"], ["Ruby"], [r"ruby-lang\.org/en/about/license"]),
    "postgresql": ("postgresql", [r"postgresql_licen[sc]e"], ["PostgreSQL"], [r"postgresql\.org/about/licence"]),
    "vim": ("vim", [r"vim_licen[sc]e"], ["Vim"], [r"vimhelp\.org/uganda"]),
    "ofl-1.1": ("font", [r"sil_open_font_licen[sc]e(?:,?_V(1\.[01]))?", r"open_font_licen[sc]e"], ["OFL-1\\.[01]"], [r"scripts\.sil\.org/ofl", r"openfontlicense\.org"]),
    "eupl-1.2": ("european", [r"european_union_public_licen[sc]e(?:,?_V(1\.[12]))?"], ["EUPL-1\\.[12]"], [r"joinup\.ec\.europa\.eu/\S*eupl"]),
    "cecill-2.1": ("cecill", [r"cecill(?:-[bc])?(?:_free_software)?_licen[sc]e", r"licence_cecill(?:-[bc])?"], ["CECILL-(?:1\\.[01]|2\\.[01]|B|C)"], [r"cecill\.info"]),
    "ms-pl": ("microsoft", [r"microsoft_public_licen[sc]e"], ["MS-PL"], [r"opensource\.org/licen[sc]es?/ms-pl"]),
    "ms-rl": ("microsoft", [r"microsoft_reciprocal_licen[sc]e"], ["MS-RL"], [r"opensource\.org/licen[sc]es?/ms-rl"]),
    "ncsa": ("ncsa", [r"(?:university_of_illinois/)?ncsa_(?:open_source_)?licen[sc]e"], ["NCSA"], [r"opensource\.org/licen[sc]es?/ncsa"]),
    "afl-3.0": ("academic", [r"academic_free_licen[sc]e(?:,?_V(3))?"], ["AFL-3\\.0"], [r"opensource\.org/licen[sc]es?/afl"]),
    "osl-3.0": ("open", [r"open_software_licen[sc]e(?:,?_V(3))?"], ["OSL-3\\.0"], [r"opensource\.org/licen[sc]es?/osl"]),
    "odbl-1.0": ("database", [r"open_(?:data_commons_open_)?database_licen[sc]e", r"open_database_licen[sc]e"], ["ODbL-1\\.0"], [r"opendatacommons\.org/licenses/odbl"]),
    "odc-by-1.0": ("commons", [r"open_data_commons_attribution_licen[sc]e"], ["ODC-By-1\\.0"], [r"opendatacommons\.org/licenses/by"]),
    "pddl-1.0": ("public", [r"public_domain_dedication_and_licen[sc]e"], ["PDDL-1\\.0"], [r"opendatacommons\.org/licenses/pddl"]),
    "cc0-1.0": ("cc", [r"cc0(?:_V(1))?(?:_universal)?", r"creative_commons_zero"], ["CC0-1\\.0"], [r"creativecommons\.org/publicdomain/zero"]),
    "cc-by-nc-nd": ("cc", [r"cc_by_nc_nd(?:_[1-4]\.[05])?", r"creative_commons_attribution_non_?commercial_no_?deriv(?:ative)?s?"], ["CC-BY-NC-ND-[1-4]\\.[05]"], [r"creativecommons\.org/licenses/by-nc-nd"]),
    "cc-by-nc-sa": ("cc", [r"cc_by_nc_sa(?:_[1-4]\.[05])?", r"creative_commons_attribution_non_?commercial_share_?alike"], ["CC-BY-NC-SA-[1-4]\\.[05]"], [r"creativecommons\.org/licenses/by-nc-sa"]),
    "cc-by-nc": ("cc", [r"cc_by_nc(?:_[1-4]\.[05])?", r"creative_commons_attribution_non_?commercial"], ["CC-BY-NC-[1-4]\\.[05]"], [r"creativecommons\.org/licenses/by-nc"]),
    "cc-by-nd": ("cc", [r"cc_by_nd(?:_[1-4]\.[05])?", r"creative_commons_attribution_no_?deriv(?:ative)?s?"], ["CC-BY-ND-[1-4]\\.[05]"], [r"creativecommons\.org/licenses/by-nd"]),
    "cc-by-sa": ("cc", [r"cc_by_sa(?:_[1-4]\.[05])?", r"creative_commons_attribution_share_?alike"], ["CC-BY-SA-[1-4]\\.[05]"], [r"creativecommons\.org/licenses/by-sa"]),
    "cc-by": ("cc", [r"cc_by(?:_[1-4]\.[05])?", r"creative_commons_attribution(?:_licen[sc]e)?"], ["CC-BY-[1-4]\\.[05]"], [r"creativecommons\.org/licenses/by"]),
    "gpl": ("gnu", [r"gnu_general_public_licen[sc]e", r"gnu_gpl"], ["GPL"], [r"gnu\.org/copyleft/gpl"]),
    "lgpl": ("gnu", [r"gnu_lgpl", r"gnu_lesser_general_public_licen[sc]e"], ["LGPL"], [r"gnu\.org/copyleft/lesser"]),
    "apache": ("apache", [r"apache_(?:software_)?licen[sc]e"], ["Apache"], [r"apache\.org/licenses"]),
    "public-domain": ("domain", [r"(?:in|into|to)_the_public_domain", r"public_domain_dedication"], ["LicenseRef-Public-Domain"], [r"creativecommons\.org/publicdomain/mark"]),
    "proprietary": ("rights", [r"all_rights_reserved", r"proprietary_and_confidential"], ["LicenseRef-Proprietary"], [r"example\.com/eula"]),
}
_VERSION = r"(?:v(?:ersion)?\.?_?)?({0})(?:\.0)*(?![0-9]|\.[0-9])"


def _expand(pattern: str) -> str:
    out = re.sub(r"V\(((?:[^()]|\([^()]*\))*)\)", lambda m: _VERSION.format(m[1]), pattern)
    return out.replace("_", r"[\s-]+").replace(r"[\s-]+?", r"[\s-]*")


def _literal(identifier: str) -> str:
    """What every match of an identifier begins with, in lower case."""
    return re.match(r"[\w-]*", identifier)[0].lower()


def _keywords(pattern: str) -> list[str]:
    """The words that every match of a name pattern holds: what stands outside groups, classes and optional letters."""
    plain = re.sub(r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\??", " ", pattern)
    plain = re.sub(r"\[[^]]*\]|\\.(?:\{[^}]*\})?|.\?", " ", plain)
    return sorted(set(re.findall(r"[a-z0-9]{2,}", plain)))


def rules() -> list[tuple[str, list[str], str, int, float]]:
    """(label, keywords that must all occur, regex, priority, weight), the most telling first: identifiers, addresses, names
    with a version, names."""
    out = []
    for label, (keyword, names, ids, addresses) in SIGNATURES.items():
        out += [(label, ["spdx", _literal(i)], rf"spdx-license-identifier:\s*\(?(?:{i})(?![\w.+-])", 1, 1.0) for i in ids]
        out += [(label, ["licen", _literal(i)], rf"\blicen[sc]e\s*[:=]\s*[\"']?(?:{i})(?![\w.+-])", 2, 0.95) for i in ids]
        out += [(label, [a.partition("\\.")[0]], rf"{a}(?![\w])", 3, 0.95) for a in addresses]
        for n in names:
            keys = _keywords(n) or [keyword]
            out.append((label, [*keys, "under"], rf"\b(?:licensed|released|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{_expand(n)}", 4 if "V(" in n else 5, 0.9))
            out.append((label, keys, rf"\b{_expand(n)}(?![\w])", 6 if "V(" in n else 7, 0.7))
    return out


def _phrase(words: str) -> str:
    return rf"(?<!{WORD}){words.replace(' ', GAP)}(?!{WORD})"


def _detections(text: Column, keywords: Column, table: list) -> Column:
    """array<struct<at, end, priority, label, weight>> of all rules whose keywords are all among those that occur."""
    fired = F.filter(
        F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, keys)).alias("keys"), F.lit("(?i)" + regex).alias("regex"), F.lit(priority).alias("priority"), F.lit(weight).alias("weight")) for label, keys, regex, priority, weight in table)),
        lambda r: F.forall(r["keys"], lambda k: F.array_contains(keywords, k)),
    )

    def places(r: Column) -> Column:
        found = F.regexp_extract_all(text, r["regex"], F.lit(0))
        between = F.split(text, r["regex"], -1)
        step = lambda s, x: F.struct(
            (s["i"] + 1).alias("i"),
            (s["at"] + F.length(x) + F.length(F.element_at(between, s["i"] + 1))).alias("at"),
            F.array_append(s["out"], F.struct(
                (s["at"] + F.length(F.element_at(between, s["i"] + 1))).alias("at"),
                (s["at"] + F.length(F.element_at(between, s["i"] + 1)) + F.length(x)).alias("end"),
                r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"))).alias("out"),
        )
        kind = "array<struct<at:int,end:int,priority:int,label:string,weight:double>>"
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(found, start, step, lambda s: s["out"])

    return F.flatten(F.transform(fired, places))


def _settled(cluster: Column) -> Column:
    """The detections of a cluster that stay: taken in order, each that overlaps none taken before. A detection is as telling as the most
    telling one inside it, so that it comes before what it contains; of those that overlap in part the more telling comes
    first, then the longer, then the earlier."""
    inside = lambda d: F.array_min(F.transform(F.filter(cluster, lambda x: (x["at"] >= d["at"]) & (x["end"] <= d["end"])), lambda x: x["priority"]))
    ranked = F.transform(cluster, lambda d: F.struct(inside(d).alias("tells"), (d["at"] - d["end"]).alias("minus_size"), *(d[c].alias(c) for c in ("at", "priority", "label", "end", "weight"))))
    taken = F.filter(ranked, lambda d: F.lit(False))
    free = lambda k, d: ~F.exists(k, lambda x: (x["at"] < d["end"]) & (d["at"] < x["end"]))
    return F.aggregate(F.array_sort(ranked), taken, lambda k, d: F.when(free(k, d), F.array_append(k, d)).otherwise(k), lambda k: F.transform(k, _said))


def _said(d: Column) -> Column:
    return F.struct(d["label"].alias("label"), d["weight"].alias("weight"))


def _resolved(found: Column) -> Column:
    """struct<labels, score> after suppression, in one pass over the detections in the order of their places. Those that overlap, one with
    the next, are a cluster, which is settled by itself; distinct labels and weights are all that is kept of it."""
    det = lambda d: F.struct(*(d[c].alias(c) for c in ("at", "end", "priority", "label", "weight")))
    ordered = F.array_sort(F.transform(found, det))
    kind, said = "array<struct<at:int,end:int,priority:int,label:string,weight:double>>", "array<struct<label:string,weight:double>>"
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(kind).alias("cluster"), F.array().cast(said).alias("out"))

    def closed(s: Column) -> Column:
        own = F.when(F.size(s["cluster"]) <= 1, F.transform(s["cluster"], _said)).otherwise(_settled(s["cluster"]))
        return F.array_union(s["out"], own)

    def step(s: Column, d: Column) -> Column:
        new = F.struct(d["end"].alias("end"), F.array(det(d)).alias("cluster"), closed(s).alias("out"))
        more = F.struct(F.greatest(s["end"], d["end"]).alias("end"), F.array_append(s["cluster"], det(d)).alias("cluster"), s["out"].alias("out"))
        return F.when(d["at"] >= s["end"], new).otherwise(more)

    out = F.aggregate(ordered, start, step, closed)
    return F.transform(F.array(out), lambda o: F.struct(F.array_distinct(F.transform(o, lambda x: x["label"])).alias("labels"), F.coalesce(F.array_max(F.transform(o, lambda x: x["weight"])), F.lit(0.0)).alias("score")))[0]


def gate() -> tuple[list[str], str]:
    """The prefilter, made from the rules: (strings, regex). Whatever a rule matches holds one of the strings, in lower case,
    or matches the regex. Most rules need "spdx" or "licen"; of the others, addresses are known by what they begin with,
    names by their own pattern, so that white space is what the rules allow."""
    needs = lambda pattern: any("licen" in k for k in _keywords(pattern))
    addresses = [a for *_, some in SIGNATURES.values() for a in some if not needs(a)]
    names = [n for _, some, *_ in SIGNATURES.values() for n in some if not needs(n)]
    begins = {re.match(r"(?:(?:[\w/-]|\\\.)(?![?*{]))*", a)[0].replace("\\.", ".") for a in addresses}
    return ["licen", "spdx", *sorted(begins)], r"(?i)\b(?:" + "|".join(dict.fromkeys(map(_expand, names))) + ")"


def count_words(text: Column) -> Column:
    """Pieces between separators, less the empty ones at the ends."""
    pieces = F.split(text, GAP, -1)
    edge = lambda i: F.when(F.element_at(pieces, i) == "", 1).otherwise(0)
    return F.greatest(F.size(pieces) - edge(1) - edge(-1), F.lit(0)).cast("long")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null counts as empty. Base places are the fixed phrases as consecutive words; base labels always stay among the
    labels. score is the largest weight of a rule that was kept, 1 if there is a base place, 0 without any label. Rows
    may repeat, ids may be null, other columns are not read; whole texts are matched, of any length; an empty table gives no rows.
    """
    require(df, id_col, text_col)
    low = F.col("low")
    has = lambda *keys: functools.reduce(Column.__and__, (F.contains(low, F.lit(k)) for k in keys))
    either = lambda conditions: functools.reduce(Column.__or__, conditions)
    base = "(?i)(?:" + "|".join(_phrase(p) for p in BASE.values()) + ")"
    table = rules()
    keywords = sorted({k for r in table for k in r[1]})
    strings, names = gate()

    # lower case of a text is made once, for keywords alone: it changes no ASCII letter into another
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    rows = rows.select(
        "doc_id", "text", count_words(F.col("text")).alias("n_words"),
        (either(has(*p.split(" ")) for p in BASE.values()) & F.col("text").rlike(base)).alias("has_base"),
        F.when(either(has(k) for k in strings) | F.col("text").rlike(names), F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))).alias("keywords"),
    )
    text, none = F.col("text"), F.array().cast("array<string>")
    before = lambda rx: F.when(F.col("has_base"), count_words(F.regexp_extract(text, rx, 1)))
    labels = F.filter(F.array(*(F.when(text.rlike("(?i)" + _phrase(p)), F.lit(label)) for label, p in BASE.items())), lambda x: x.isNotNull())
    nothing = F.struct(none.alias("labels"), F.lit(0.0).alias("score"))
    rows = rows.select(
        "doc_id", "n_words", F.when(F.col("has_base"), F.regexp_count(text, F.lit(base))).otherwise(0).cast("long").alias("n_base"),
        before(rf"(?s)^(.*?){base}").alias("first_word"), before(rf"(?s)^(.*){base}").alias("last_word"),
        F.when(F.col("has_base"), labels).otherwise(none).alias("base"),
        F.when(F.col("keywords").isNotNull(), _resolved(_detections(text, F.col("keywords"), table))).otherwise(nothing).alias("method"),
    )
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "method.labels")).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("method.score")).alias("score"),
    )
