import random
import re
import re._constants as sre

import pytest
from pyspark.sql import functions as F

from quarry.llm.licenses import _resolved, rules, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEXTS = {
    1: ("Released under the MIT License.", {"mit"}), 2: ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}), 3: ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}), 4: ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
    5: ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}), 6: ("mozilla public license 2.0", {"mpl-2.0"}), 7: ("commit to submit the emitted license", set()), 8: ("", set()), 9: (None, set()), 10: ("😀 cc by. 😀cc by mit license", {"cc-by", "mit"}),
    11: ("gnu lesser general public license v2.1", {"lgpl-2.1"}), 12: ("See https://www.gnu.org/licenses/agpl-3.0.html", {"agpl-3.0"}), 13: ("CC BY-NC-SA 4.0, not CC BY 4.0", {"cc-by", "cc-by-nc-sa"}), 14: ("word " * 60_000 + "mit license " * 300, {"mit"}), 15: ("émit license and mit licensed", set()),
    16: ("gnu\n general -- public\x00license", {"gpl"}), 17: ("MIT license MIT license", {"mit"}), 18: ("dedicated to the public domain", {"public-domain"}),
}


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_and_labels(spark):
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in TEXTS.items()] + [(None, "mit license", "x"), (1, TEXTS[1][0], "x")], "doc_id long, text string, labels string")
    out = scan(df).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        text, labels = TEXTS.get(r.doc_id, ("mit license", {"mit"}))
        assert tuple(r)[1:6] == brute(text), r
        assert set(filter(None, r.labels.split(","))) == labels, r
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert scan(df.limit(0)).count() == 0


def test_rules_are_many_and_compile(spark):
    every = rules()
    assert len(every) > 300 and len({r[0] for r in every}) > 50
    row = spark.range(1).selectExpr(*[f"'' rlike r'{regex}' AS c{i}" for i, (_, _, regex, _, _) in enumerate(every) if "'" not in regex]).first()
    assert not any(row)


def test_keywords_and_gate_miss_nothing(spark):
    """A rule's literal words imply its keywords, and every keyword set implies a gate word or an address."""
    for label, keys, regex, _, _ in rules():
        assert keys and all(keys), (label, regex)
        plain = re.sub(r"\\\\|[\[\]()?:|]", "", regex.lower())
        assert all(k in plain for k in keys), (label, keys, regex)
    said = {"cc0-1.0": "CC0 1.0 Universal", "mit": "mit/x11", "wtfpl": "do what the fuck you want to public license", "vim": "Vim License", "cc-by-nc-nd": "CC-BY-NC-ND 4.0", "python-2.0": "PSF License", "unlicense": "the Unlicense", "bsd": "Berkeley Software Distribution bsd", "apache-2.0": "ASL 2.0 apache", "ofl-1.1": "SIL Open Font License", "cc-by-nd": "creative commons attribution no derivs cc", "mpl-2.0": "https://mozilla.org/MPL/2.0", "isc": "License: ISC", "postgresql": "SPDX-License-Identifier: PostgreSQL", "odbl-1.0": "Open Database License"}
    df = spark.createDataFrame(list(said.items()), "doc_id string, text string")
    for r in scan(df).collect():
        assert r.doc_id in r.labels.split(","), r


def example(parsed, blank):
    """A short text that a parsed pattern matches: first branches, least repeats, ``blank`` where white space may stand."""
    out = ""
    for op, arg in parsed:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.IN:
            out += blank if (sre.CATEGORY, sre.CATEGORY_SPACE) in arg else next(chr(x if kind is sre.LITERAL else x[0]) for kind, x in [*arg, (sre.LITERAL, ord("x"))] if kind is not sre.CATEGORY)
        elif op is sre.MAX_REPEAT:
            out += example(arg[2], blank) * arg[0]
        elif op is sre.SUBPATTERN:
            out += example(arg[3], blank)
        elif op is sre.BRANCH:
            out += example(arg[1][0], blank)
    return out


@pytest.mark.parametrize("blank", [" ", "\n", "  ", "-"])
def test_every_rule_matches_alone(spark, blank):
    """Each name, address and identifier with nothing beside it, in capitals too."""
    texts = [(regex, t) for _, _, regex, _, _ in rules() for own in [example(re._parser.parse(regex), blank)] if re.search(regex, own) for t in (own, own.upper())]
    assert len(texts) > (700 if blank != "-" else 500)
    missed = [r for r in scan(spark.createDataFrame(texts, "doc_id string, text string")).collect() if not r.labels or not r.score]
    assert not missed, missed[:5]


ALONE = {
    "MPL 2.0": "mpl-2.0", "MPL 1.1": "mpl-1.1", "ASL 2.0": "apache-2.0", "MIT No Attribution": "mit-0", "Berkeley Software Distribution": "bsd", "proprietary and confidential": "proprietary",
    "do what the f... you want to": "wtfpl", "eclipse.org/legal/epl-v10": "epl-1.0", "wtfpl.net": "wtfpl", "cecill.info": "cecill-2.1", "vimhelp.org/uganda": "vim", "scripts.sil.org/ofl": "ofl-1.1", "mariadb.com/bsl11": "busl-1.1",
    "joinup.ec.europa.eu/x/eupl": "eupl-1.2", "to the public\ndomain": "public-domain", "all rights\nreserved": "proprietary", "CC  BY-NC": "cc-by,cc-by-nc", "simple example of the accbyte": "",
}


def test_names_and_addresses_without_padding(spark):
    assert {r.doc_id: r.labels for r in scan(spark.createDataFrame([(t, t) for t in ALONE], "doc_id string, text string")).collect()} == ALONE


def settle(found):
    """Suppression by its definition, over all detections of a text at once."""
    tells = lambda d: min(x[2] for x in found if d[0] <= x[0] and x[1] <= d[1])
    kept = []
    for d in sorted(found, key=lambda d: (tells(d), d[0] - d[1], d[0], d[2], d[3])):
        if all(x[1] <= d[0] or d[1] <= x[0] for x in kept):
            kept.append(d)
    return {d[3] for d in kept}, max((d[4] for d in kept), default=0.0)


def test_suppression_against_its_definition(spark):
    rng, rows = random.Random(6), [(0, [])]
    for i in range(1, 400):
        places = [(a, a + rng.randint(1, 12), rng.randint(1, 7), rng.choice("abcdef"), rng.choice([0.7, 0.9, 1.0])) for a in (rng.randrange(60) for _ in range(rng.randint(1, 14)))]
        rows.append((i, places))
    kind = "id int, found array<struct<at:int,end:int,priority:int,label:string,weight:double>>"
    out = spark.createDataFrame(rows, kind).select("id", _resolved(F.col("found")).alias("r")).collect()
    assert {r.id: (set(r.r.labels), r.r.score) for r in out} == {i: settle(found) for i, found in rows}
    # b is inside a; c, more telling, overlaps a at its end and replaces it: b comes back
    back = [(0, 10, 7, "a", 0.7), (0, 4, 7, "b", 0.7), (8, 20, 6, "c", 0.7)]
    assert settle(back)[0] == {"b", "c"}
    assert set(spark.createDataFrame([(1, back)], kind).select(_resolved(F.col("found")).alias("r")).first().r.labels) == {"b", "c"}


def test_every_rule_gives_its_own_label(spark):
    """What a rule matches, with nothing beside it, gets that rule's label or one that is told by more of the text or a better rule."""
    every = rules()
    own = [(i, example(re._parser.parse(regex), " ")) for i, (_, _, regex, _, _) in enumerate(every)]
    own = [(i, t) for i, t in own if re.search(every[i][2], t)]
    assert len(own) > 400
    for r in scan(spark.createDataFrame(own, "doc_id int, text string")).collect():
        label, _, regex, priority, _ = every[r.doc_id]
        text = dict(own)[r.doc_id]
        better = {x[0] for x in every if (m := re.search("(?i)" + x[2], text)) and (x[3] < priority or len(m[0]) >= len(re.search("(?i)" + regex, text)[0]))}
        assert label in r.labels.split(",") or better & set(r.labels.split(",")), (label, text, r.labels)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|MapIn|Exchange", plan)


@pytest.mark.parametrize("text,labels", [("apache license 2.0 apache license", "apache,apache-2.0"), ("the gnu gpl v2 or gnu gpl v3", "gpl-2.0,gpl-3.0")])
def test_containment_keeps_the_longer(spark, text, labels):
    assert scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels
