"""Line templates and license scans against brute-force versions."""

import math
import random
import re
import textwrap
from collections import Counter, defaultdict

from specweave.llm import licenses, lines

DOCS = "doc_id long, text string, clean_text string"


def brute_lines(texts, least_docs, similar=lines.SIMILAR):
    """The definition, line by line: the most general similar template, in enough documents."""
    parse = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))
    own = [{p for p in map(parse, (t or "").split("\n")) if set(p) - {"<*>"}} for t in texts]
    n, gone = Counter(p for lines_of in own for p in lines_of), set()
    for turn in (lambda p: p, lambda p: p[::-1]):  # by the first tokens, then by the last ones
        weight = Counter()
        for p, k in n.items():
            leaf = len(p), turn(p)[: lines.LEADING]
            weight[leaf] += k
            for place, token in enumerate(turn(p)[lines.LEADING :]):
                weight[leaf, place, token] += k
        template, docs = {}, defaultdict(set)
        for p in n:
            leaf = len(p), turn(p)[: lines.LEADING]
            weights = [weight[leaf]] * len(leaf[1]) + [weight[leaf, place, token] for place, token in enumerate(turn(p)[lines.LEADING :])]
            least = sorted(weights, reverse=True)[-(-similar * len(p) // 100) - 1]
            general = tuple(t if w >= least else "<*>" for t, w in zip(turn(p), weights, strict=True))
            template[p] = (leaf, general) if general == turn(p) or sum(t != "<*>" for t in general) >= lines.LEAST_WORDS else None
        for d, lines_of in enumerate(own):
            for p in lines_of:
                docs[template[p]].add(d)
        gone |= {p for p in n if template[p] and len(docs[template[p]]) >= least_docs}
    return ["\n".join(x for x in (t or "").split("\n") if parse(x) not in gone) if t is not None else None for t in texts]


NAMES = "Ann Bob Cyd Dan Eve".split()


def test_several_templates_a_leaf(spark):
    """Templates of the same length and leading tokens don't hide one another."""
    one = [f"we are open from monday to friday at nine {w}" for w in NAMES]
    two = [f"we are open but {w} is not in until the evening" for w in NAMES]
    three = [f"we are open on most days {w} said to the press" for w in NAMES]
    rare = ["we are open to all that is new in art"]
    texts = [f"text {a} own {w}\n{x}" for w, lines_ in (("a", one), ("b", two), ("c", three)) for a, x in zip("qwert", lines_, strict=True)] + rare
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, gone int")
    got = {r["doc_id"]: r for r in lines.drop_recurring_lines(docs, id_col="doc_id").collect()}
    assert [got[i]["clean_text"] for i in range(15)] == [t.split("\n")[0] for t in texts[:15]]
    assert got[15]["clean_text"] == rare[0] and got[0]["k1"] == "k" and got[0]["gone"] == 7
    assert [got[i]["clean_text"] for i in sorted(got)] == brute_lines(texts, lines.LEAST_DOCS)
    # One value that is frequent itself does not split a template.
    values = spark.createDataFrame([(i, f"the order of {w} has been sent out on time") for i, w in enumerate(["Ann"] * 4 + NAMES[1:])], "doc_id long, text string")
    assert {r["clean_text"] for r in lines.drop_recurring_lines(values).collect()} == {""}


def test_words_that_vary_at_the_start(spark):
    """A name among the first tokens is a field like any other; sentences that share a few words stay."""
    going = [f"order for {w} was sent to the customer today" for w in NAMES] + [f"{w} wrote this post on our site" for w in NAMES]
    staying = [f"I like the {w}" for w in "sun moon rain snow wind".split()] + [f"I like the {w} here" for w in "sun moon rain snow wind".split()] + [f"{w} was not at home today" for w in NAMES]
    texts = [f"text {a} is own {a}{b}\n{x}" for a, b, x in zip("qwertyuiopasdfghjklzxcvbnm", "mnbvcxzlkjhgfdsapoiuytrewq", going + staying, strict=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["clean_text"] for r in lines.drop_recurring_lines(docs, id_col="doc_id").collect()}
    assert [got[i] for i in range(10)] == [t.split("\n")[0] for t in texts[:10]] and [got[i] for i in range(10, len(texts))] == texts[10:]
    assert [got[i] for i in sorted(got)] == brute_lines(texts, lines.LEAST_DOCS)


def test_odd_lines(spark):
    """Short lines, numbers, blank lines, very long texts, repeated rows and ids."""
    long = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} of the long text {'x' * (i % 7)}" for i in range(30_000)) + "\nshort\n" + "word " * 20_000
    texts = [long, long, *["short\n\n12 13\n  "] * 3, "short", "12 13", None, "", "\n", *["Page 3\tof 17"] * 4, "page 3 of 17", " Page  4 of 9 "]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").repartition(3)
    got = Counter(r["clean_text"] for r in lines.drop_recurring_lines(docs, id_col="doc_id").collect())
    assert got == Counter(brute_lines(texts, lines.LEAST_DOCS))


def test_lines_random(spark):
    rng = random.Random(17)
    texts = ["\n".join(" ".join([rng.choice(["a b c", "a b d", "a 5 c"]), *(rng.choice("pqrs7") for _ in range(rng.choice([0, 1, 2, 4, 5])))]) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["clean_text"] for r in lines.drop_recurring_lines(docs, least_docs=8).collect()}
    assert [got[i] for i in range(300)] == brute_lines(texts, 8)


def test_lines_brute(spark):
    texts = [f"own words {w} of text {w}\nOrder 12{i} was sent to {name} on day {i} by our staff\nshared line of all texts here\nend" for i, (w, name) in enumerate(zip("abcdefgh", ["Ann", "Bob", "Cyd", "Dan", "Eve", "Flo", "Gus", "Hal"], strict=True))]
    texts += [None, "", "end", "alone in the world\n\nalone in the world", "shared line of all texts here", texts[0]]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = lines.drop_recurring_lines(rows, least_docs=4).orderBy("doc_id").collect()
    assert [r["clean_text"] for r in got] == brute_lines(texts, 4)
    assert got[1]["n_dropped"] == 3 and got[1]["n_lines"] == 4 and got[8]["n_lines"] == 0
    assert lines.drop_recurring_lines(rows.limit(0)).count() == 0


def test_lines_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["clean_text"] for r in lines.drop_recurring_lines(docs).collect()}
    ids, texts = zip(*[(r["doc_id"], r["text"]) for r in docs.collect()], strict=True)
    assert got == dict(zip(ids, brute_lines(texts, lines.LEAST_DOCS), strict=True))


def brute_blocks(text):
    """Runs of lines with a letter or digit; a comment ends a run where it ends itself."""
    out, last = [[]], False
    for line in text.split("\n"):
        comment = bool(re.match(r"[ \t]*(#|//|/?\*|--|;|%)", line))
        if last and not comment:
            out.append([])
        if re.search("[A-Za-z0-9]", line):
            out[-1].append(line)
        else:
            out.append([])
        last = comment
    return ["\n".join(b) for b in out if b]


def brute_comments(text):
    """Runs of comment lines and of other lines."""
    out, last = [], None
    for line in text.split("\n"):
        comment = bool(re.match(r"[ \t]*(#|//|/?\*|--|;|%)", line))
        if comment != last:
            out.append([])
        out[-1].append(line)
        last = comment
    return ["\n".join(b) + "\n" * (i < len(out) - 1) for i, b in enumerate(out)]


def inherited(files, own, path):
    """The license of the nearest directory above a path, one directory after another."""
    folder = path
    while folder:
        folder = folder.rpartition("/")[0]
        named = [p for p in files if p.rpartition("/")[0] == folder]
        here = sorted(p for p in named if p in own and re.match(r"(?i)((un)?licen[cs]e|copying|notice)([-._].*)?$", p.rpartition("/")[2]))
        if here:
            return own[here[0]], folder
        if any(re.match(r"(?i)((un)?licen[cs]e|copying)([-._].*)?$", p.rpartition("/")[2]) and licenses.terms_of(files[p] or "") for p in named):
            return "unknown", folder
    return None, None


def wrapped(paragraphs, mark, width=70):
    """The paragraphs as a header of comment lines."""
    lines_ = [line for p in paragraphs for line in [*textwrap.wrap(p, width), ""]]
    return "\n".join(f"{mark} {line}".rstrip() for line in lines_[:-1])


def test_headers(spark):
    code = "\n".join(f"x_{i} = compute_{i}(y_{i}, {i}) # step" for i in range(200))
    gnu = lambda kind, version: [p.format(kind=kind, version=version) for p in licenses.GNU]
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + "\n\n".join("\n".join(textwrap.wrap(p, 78)) for p in licenses.MIT)
    files = {
        "a/LICENSE": mit,
        "a/b/part.py": code,
        "most/LICENSE.txt": mit[: mit.rindex("IN NO EVENT")],
        "one/COPYING": " ".join(licenses.MIT),
        "g/three.py": wrapped(gnu("General Public License", "3"), "#") + "\n" + code,
        "g/two.c": "/*\n" + wrapped(gnu("General Public License", "2"), " *") + "\n */\n" + code,
        "g/lesser.c": wrapped(gnu("Lesser General Public License", "3"), "//") + "\n\n" + code,
        "g/affero.sql": wrapped(gnu("Affero General Public License", "3"), "--") + "\n" + code,
        "b/bsd.py": "# Copyright A. Person\n" + wrapped(licenses.BSD_3, "#") + "\n" + code,
        "p/apache.js": wrapped(licenses.APACHE_2, "//") + "\n" + code,
        "p/code.js": code,
        "p/prose.txt": "The program is free and the people who use it may copy the text of the file\n" * 30,
        "p/long.txt": "word " * 50_000,
    }
    table = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {r["path"]: r for r in licenses.license_scan(table).collect()}
    want = {"a/LICENSE": "MIT", "most/LICENSE.txt": "MIT", "one/COPYING": "MIT", "g/three.py": "GPL-3.0", "g/two.c": "GPL-2.0", "g/lesser.c": "LGPL-3.0", "g/affero.sql": "AGPL-3.0", "b/bsd.py": "BSD-3-Clause", "p/apache.js": "Apache-2.0"}
    assert {p: r["own_license"] for p, r in got.items() if r["own_license"]} == want == brute_scan(files)
    assert {p: (r["license"], r["inherited_from"]) for p, r in got.items() if not r["own_license"]} == {p: inherited(files, want, p) for p in files if p not in want}
    assert got["a/b/part.py"]["license"] == "MIT"


def brute_scan(files, threshold=licenses.THRESHOLD):
    df = Counter(t for text in files.values() for t in set(licenses.terms_of(text or "")))
    known = {t for _, text in licenses.TEMPLATES for t in licenses.terms_of(text)}
    idf = lambda t: math.log((1 + len(files)) / (1 + (df[t] if t in known else 0))) + 1
    vector = lambda text: {t: n * idf(t) for t, n in Counter(licenses.terms_of(text)).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    out = {}
    for path, text in files.items():
        best = []
        declared = re.search(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)", text or "")
        if declared:
            out[path] = re.sub(r"(-only|-or-later|\+)$", "", declared[1])
            continue
        for unit in {*(text or "").split("\n"), *brute_blocks(text or ""), *brute_comments(text or ""), text or ""}:
            u = vector(unit)
            for name, template in licenses.TEMPLATES:
                t = vector(template)
                c = sum(w * t.get(k, 0) for k, w in u.items()) / (norm(u) * norm(t) or 1)
                if round(c, 6) >= threshold:
                    best.append((licenses.rank(name, template), -round(c, 6), name))
        if best:
            out[path] = min(best)[2]
    return out


def test_licenses_brute(spark):
    files = {
        "a/LICENSE": "Released under the MIT License.",
        "a/x.txt": "some words\nmore words",
        "a/b/COPYING": "This work is licensed under the GNU General Public License, version 3.\nand words",
        "a/b/c/y.txt": "text",
        "a/b/c/z.txt": "text\nLicensed under the Apache License, Version 2.0.\nwords",
        "q/w.txt": "no license above",
        "n.txt": None,
        "r/readme": "All rights reserved.",
    }
    table = spark.createDataFrame([(*x, "own", "x") for x in [*files.items(), (None, "Released under the MIT License."), ("a/x.txt", files["a/x.txt"])]], "path string, text string, license string, `from` string")
    got = licenses.license_scan(table).collect()
    assert len(got) == 10
    by = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in got}
    assert by["a/LICENSE"] == ("MIT", "MIT", None)
    assert by["a/x.txt"] == (None, "MIT", "a")
    assert by["a/b/c/y.txt"] == (None, "GPL-3.0", "a/b")
    assert by["a/b/c/z.txt"][:2] == ("Apache-2.0", "Apache-2.0")
    assert by["q/w.txt"] == by["n.txt"] == by[None] == (None, None, None)
    assert by["r/readme"][0] == "All-Rights-Reserved"
    assert licenses.license_scan(table.limit(0)).count() == 0


def test_licenses_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("concat('d/', doc_id) as path", "text")
    got = {r["path"]: r["own_license"] for r in licenses.scan(docs).collect()}
    assert got == brute_scan({r["path"]: r["text"] for r in docs.collect()}) and got


CODE = "\n".join(f"def f{i}(x{i}): return g{i}(x{i}, y{i}) + {i} * z{i}" for i in range(60))


def text_of(title, paragraphs, width=76):
    return title + "\n\n" + "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in paragraphs) + "\n"


def standard_files():
    """Licence files and headers as they are usually found, with the license that each has."""
    owner = "Copyright (c) 2021, A. Person\nAll rights reserved."
    numbered = [licenses.BSD_3[0], "1. " + licenses.BSD_3[1], "2. " + licenses.BSD_3[2], "3. " + licenses.BSD_3[3], licenses.BSD_3[4]]
    two = [*numbered[:3], numbered[4]]
    zlib = [*licenses.ZLIB[:2], *[f"{n}. {p}" for n, p in enumerate(licenses.ZLIB[2:], 1)]]
    definitions = ["\"Source\" form shall mean the preferred form for making modifications, including but not limited to software source code, documentation source, and configuration files.", "Each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license."] * 6
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"
    gnu = ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", *definitions]
    return {
        "bsd3/LICENSE": (text_of("BSD 3-Clause License\n\n" + owner, numbered), "BSD-3-Clause"),
        "bsd2/LICENSE": (text_of("BSD 2-Clause License\n\n" + owner, two), "BSD-2-Clause"),
        "bsd3/x.c": ("/*\n * " + owner.replace("\n", "\n * ") + "\n *\n" + wrapped(numbered, " *") + "\n */\n" + CODE, "BSD-3-Clause"),
        "bsd2/x.c": ("/*\n * " + owner.replace("\n", "\n * ") + "\n *\n" + wrapped(two, " *") + "\n */\n" + CODE, "BSD-2-Clause"),
        "zlib/LICENSE.txt": (text_of("Copyright (C) 1995-2022 A. Person", zlib), "Zlib"),
        "lesser/x.h": (wrapped(licenses.LGPL_2_1, "//") + "\n\n" + CODE, "LGPL-2.1"),
        "lesser/COPYING.LESSER": ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n" + text_of("", gnu), "LGPL-2.1"),
        "g2/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + text_of("", gnu), "GPL-2.0"),
        "g3/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + text_of("", gnu), "GPL-3.0"),
        "apache/LICENSE": (apache + text_of("", definitions), "Apache-2.0"),
        "apache/full/LICENSE": (apache + text_of("", [*definitions, *licenses.APACHE_2]), "Apache-2.0"),
        "mit/LICENSE": (text_of("MIT License\n\n" + owner, licenses.MIT), "MIT"),
        "spdx/a.py": ("# SPDX-License-Identifier: Apache-2.0\n" + CODE, "Apache-2.0"),
        "spdx/b.c": ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */\n" + CODE, "GPL-2.0 WITH Classpath-exception-2.0"),
        "spdx/c.rs": ("// Copyright X. All rights reserved.\n// SPDX-License-Identifier: MIT OR Apache-2.0\n" + CODE, "MIT OR Apache-2.0"),
        "spdx/d.js": ("// SPDX-License-Identifier:\n" + CODE, None),
        "closed/x.py": ("# Copyright X. All rights reserved.\n# nothing else is said\n" + CODE, None),
    }


def test_standard_files(spark):
    files = standard_files()
    own = {p: x for p, (_, x) in files.items() if x}
    table = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    got = {r["path"]: r["own_license"] for r in licenses.scan(table).collect()}
    assert got == own


def test_unknown_licences_stop_inheritance(spark):
    mit, other = "Released under the MIT License.", "You may use this on Tuesdays if you feed the cat of the author."
    files = {
        "LICENSE": mit, "x.py": "x", "lib/LICENSE": other, "lib/x.py": "x", "lib/deep/er/x.py": "x", "lib/deep/LICENSE": mit, "both/LICENSE": other, "both/LICENSE.mit": mit, "both/x.py": "x",
        "note/NOTICE": other, "note/x.py": "x", "blank/LICENSE": " \n", "blank/x.py": "x", "none/COPYING": None, "none/x.py": "x",
    }
    table = spark.createDataFrame([(*f, 1, "c", 0.5) for f in files.items()], "path string, text string, __path int, at string, Cosine double")
    for keep in (True, False):
        got = {r["path"]: r for r in licenses.license_scan(table, keep_text=keep).collect()}
        own = {p: "MIT" for p, t in files.items() if t == mit}
        assert {p: (r["license"], r["inherited_from"]) for p, r in got.items()} == {p: (own[p], None) if p in own else inherited(files, own, p) for p in files}
        assert got["lib/x.py"]["license"] == "unknown" and got["lib/deep/er/x.py"]["license"] == "MIT" and got["x.py"]["__path"] == 1 and ("text" in got["x.py"].asDict()) == keep


def test_inheritance_with_hot_directories(spark, monkeypatch):
    """Each path meets '' and the other directories above it, however many paths share them."""
    monkeypatch.setattr("specweave.llm.common.HOT_ROWS", 5)
    files = {"LICENSE": "Released under the MIT License."} | {f"d{i % 7}/e{i % 3}/f{i}.txt": "x" for i in range(90)} | {"d1/COPYING": "Licensed under CC BY 4.0.", "d2/e0/LICENSE": "who knows"}
    got = licenses.license_scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()
    own = {"LICENSE": "MIT", "d1/COPYING": "CC-BY-4.0"}
    assert {r["path"]: (r["license"], r["inherited_from"]) for r in got} == {p: (own[p], None) if p in own else inherited(files, own, p) for p in files}
