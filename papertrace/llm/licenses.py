"""Licence scans by canonical digest: whole texts, and whole lines, looked up among known digests.

Canonical form: ASCII lower case; lines that only claim copyright are left out; everything but a-z and 0-9 is
one space; equivalent spellings become one. Two texts that differ in nothing else have the same SHA-256.
Known licences are kept as digests, so the look-up is an equi-join with a table of fixed size.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, text_of, unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines (in canonical form) that claim copyright and grant nothing.
COPYRIGHT = (
    r"^(portions )?(copyright( c)?|c)( by)?( [0-9]{4}.*| year.*| yyyy.*)$|^(portions )?copyright c( .*)?$|^(portions )?copyright .* (19|20)[0-9]{2}$"
    r"|^(portions )?copyright .* (inc|llc|ltd|corp|corporation|gmbh|foundation)( all rights reserved)?$|^all rights reserved$"
)
#: Spellings that licence matching treats as equal.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub licensable", "sublicensable"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("wilful", "willful"), ("whilst", "while"), ("organisation", "organization"),
    ("organisations", "organizations"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"),
)
#: SPDX id -> SHA-256 of the canonical form: of whole licence texts, with and without their headings and
#: appendices, as distributions ship them.
KNOWN: dict[str, tuple[str, ...]] = {
    "0BSD": (
        "135f996b0799264a94667b307181b4e708ac75af3dd183e62a37bd0555cbf0cc",
        "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c",
        "3d7b7ce2a6e224f3ce2c959b8b26ed63938ae9ac89a1a93812c66acfe9971516",
        "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153",
    ),
    "Apache-2.0": (
        "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
        "2b4a3f34572f63637f58db72bdacad38516a1e1e6788b08931d0a0d5c0be33dd",
        "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959",
        "6530dac82be99e5bbcc128a6caf5bfdd0451a21fe23ac3df15ed85a1c550c859",
        "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64",
        "d7dd8e5c661e35d656a43688fc21624b0ba52216e4c419c747129bf83780d165",
        "d849700f6ffe2241c4de5c4f77cc6ee7a152ddfbb1ec7385106677e743be07a7",
        "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
        "f761755a124d5b120462472e2bc82cd8441992f62440982a246977b1e7f8b8dc",
        "fb388936c12fba660a278043424b3f9a17c6b2e536674e390813ac3d06e7e73a",
    ),
    "BSD-2-Clause": (
        "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2",
        "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2",
        "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74",
        "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
        "b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893",
        "dfb735646da984cb814b2aab18aef097d6e575950073bd82353f618e44014642",
        "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9",
        "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b",
    ),
    "BSD-3-Clause": (
        "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903",
        "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa",
        "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da",
        "85a253fdca75357d8f16143d242204d0c291650df54bf470a94c229f0d848c65",
        "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
        "afc81ee99a150bf9ad976d1b4b3bae3ec8fb30e82c7f9ec18d0048b070d2ebc8",
        "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15",
        "d1ecc0a46c23dad7f9e13b19b877e5be7ec9d2b9bb05a2dfde2e47be83438590",
        "e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e",
        "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af",
    ),
    "CC0-1.0": (
        "4f8ab63ace774f37529081c81e2730a88143bf70e67392bd3c3701bd0a175152",
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "GPL-2.0-only": (
        "07f9dc67ef43f8488ad21cd89644097f06a71dca46dd84f7c712db10702b0dea",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "98e760555ff723908d803b23140ebd264fee15e7615bf9486faa0f8f6596c34f",
        "bfca6618ea38de65984d68db07b3047b7994b510ffff2cb850951e069529b8ef",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    ),
    "GPL-3.0-only": (
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "1ac3ee43258868524b595aa6806399028b859e6815adb29e1206f809442847d5",
        "80d2bf43efa136ac2e7270ccf874f8bcfa290c73ed98846547ea57c88da9dc77",
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "fad6d14122ae5943ea05f9e4d48194524a0b701f034fd22c7dded3e6c296c742",
    ),
    "ISC": (
        "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a",
        "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1",
        "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db",
        "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee",
    ),
    "LGPL-2.1-only": (
        "2ef2859ae4577e1d4a14d215abfe8c8b9f6e4ba7dca97a8b81b6c205bf62d7ad",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "73ac55304afe4c219acdd0cb7683daf4fe3772c9b493da4a095d93a7789311d5",
        "91fba5fd5007350e2589cef732142c99ceaac0b15c8e36db486ec21766e5c803",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ),
    "LGPL-3.0-only": (
        "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a",
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MIT": (
        "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c",
        "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164",
        "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f",
        "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127",
        "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4",
    ),
    "MPL-2.0": (
        "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3",
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ),
    "Unlicense": (
        "e004e218cb49cc5380ae88b74959546d5ffade35d8fa0f2d1fe2c87f91a33b89",
        "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229",
        "fc1f640c3081f07200157ecf84866a527c48cd3f1ae37f29a2631e58e7adbc0a",
    ),
    "Zlib": (
        "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7",
        "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a",
        "ee37bc3ccba61ff28a10c05f28bdabf7466db400a75d9a1890fb865cda23e145",
    ),
}
#: Notices in plain words, from which further digests are made. {0} is the licence's name.
_NAMES = {
    "MIT": ("MIT License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"), "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License version 3.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License version 2.0"), "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",), "AGPL-3.0-only": ("GNU Affero General Public License, version 3",),
    "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License",), "MPL-2.0": ("Mozilla Public License, version 2.0",), "Unlicense": ("Unlicense",),
    "CC-BY-4.0": ("CC BY 4.0",), "CC-BY-SA-4.0": ("CC BY-SA 4.0",), "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0",), "CC0-1.0": ("CC0 1.0",),
}
_NOTICES = ("{0}", "The {0}", "Licensed under {0}.", "Licensed under the {0}.", "Released under the {0}.", "Released under {0}.", "Distributed under the {0}.", "This work is licensed under the {0}.", "This work is licensed under {0}.", "Available under the {0}.", "Published under the {0}.")


def canonical_of(text: str | None) -> str:
    """The canonical form, as canonical() gives it."""
    lines = [re.sub("[^a-z0-9]+", " ", x.translate(str.maketrans(_UPPER, _LOWER))).strip(" ") for x in (text or "").split("\n")]
    out = " ".join(x for x in lines if x and not re.search(COPYRIGHT, x))
    for a, b in SPELLINGS:
        out = re.sub(rf"\b{a}\b", b, out)
    return out


def digest_of(text: str | None) -> str:
    """The SHA-256 under which a licence text is known."""
    return hashlib.sha256(canonical_of(text).encode()).hexdigest()


def digests() -> dict[str, str]:
    """digest -> SPDX id, of all that is known. SPDX tags are notices too."""
    out = {d: k for k, ds in KNOWN.items() for d in ds}
    for spdx, names in _NAMES.items():
        for name in names:
            out |= {digest_of(n.format(name)): spdx for n in _NOTICES}
        out[digest_of(f"SPDX-License-Identifier: {spdx}")] = spdx
    return out


#: Digests that a registry may have: it is part of the plan, and broadcast.
MOST_DIGESTS = 20_000


def registry(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    """(digest, license): a few hundred rows, whatever the corpus. `more` adds digests of one's own."""
    return ready(spark).createDataFrame(sorted((digests() | (more or {})).items()), "digest string, license string")


def _lines(text: Column) -> Column:
    # what is left after the replacement is ASCII, on which lower() does A-Z only; lone spaces stay as they are
    flat = F.lower(F.regexp_replace(text, r"[^A-Za-z0-9\n ][^A-Za-z0-9\n]*| [^A-Za-z0-9\n]+", " "))
    lines = F.transform(F.split(flat, "\n"), lambda x: F.btrim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def _spelled(c: Column) -> Column:
    """Equivalent spellings made one; c is bound once, and most texts hold none of them."""
    def chain(x: Column) -> Column:
        y = x
        for a, b in SPELLINGS:
            y = F.regexp_replace(y, rf"\b{a}\b", b)
        return F.when(reduce(Column.__or__, (F.contains(x, F.lit(a)) for a, _ in SPELLINGS)), y).otherwise(x)

    return F.get(F.transform(F.array(c), chain), 0)


def canonical(text: str | Column) -> Column:
    """The canonical form of a text (null: empty). JVM only."""
    return _spelled(F.array_join(_lines(text_of(text)), " "))


def scan(df: DataFrame, text: str = "text", more: dict[str, str] | None = None) -> DataFrame:
    """df with text_digest, license (of a text that is a known licence or notice as a whole) and notices (ids
    of known notices that stand in lines of their own, sorted, once each, joined by a comma).

    Null where there is none. A null or empty text, or one of copyright lines only, is no licence. Texts and lines of
    any length are taken whole. Rows are
    independent; a repeated row stays; other columns pass, but those of the three names are replaced; an
    empty table stays empty. JVM only: a hash join for texts, and a look-up of each line's digest."""
    spark = df.sparkSession
    known = registry(spark, more)
    table = digests() | (more or {})
    if len(table) > MOST_DIGESTS:
        raise ValueError(f"more than {MOST_DIGESTS} digests")
    lookup = F.create_map(*(F.lit(x) for kv in sorted(table.items()) for x in kv))
    df = df.drop("text_digest", "license", "notices")
    lines = unused(df, "_lines")[0]
    df = df.withColumn(lines, _lines(text_of(text))).withColumn("text_digest", F.sha2(_spelled(F.array_join(lines, " ")), 256))
    # a set finds the few lines that are known; the map, which is searched in turn, names them
    some = F.filter(F.transform(lines, lambda x: F.sha2(_spelled(x), 256)), lambda d: d.isin(*sorted(table)))
    hit = F.transform(some, lambda d: F.try_element_at(lookup, d))
    df = df.withColumn("notices", F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(hit, lambda x: x.isNotNull()))), ","), F.lit(""))).drop(lines)
    return df.join(F.broadcast(known.withColumnRenamed("digest", "text_digest")), "text_digest", "left")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for scan(): (doc_id, text_digest, license, notices)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def spelled(e: str) -> str:
        for a, b in SPELLINGS:
            e = f"regexp_replace({e}, {q(rf'\b{a}\b')}, {q(b)}, 'g')"
        return e

    values = ", ".join(f"({q(d)}, {q(k)})" for d, k in sorted(digests().items()))
    return rf"""
WITH known(digest, license) AS (VALUES {values}),
lines AS (
  SELECT doc_id, rid, list_filter(list_transform(string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')),
         lambda x: x <> '' AND NOT regexp_matches(x, {q(COPYRIGHT)})) AS l
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM {table})),
whole AS (SELECT doc_id, rid, sha256({spelled("array_to_string(l, ' ')")}) AS text_digest FROM lines),
each AS (SELECT rid, unnest(l) AS x FROM lines),
found AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM each JOIN known ON sha256({spelled("x")}) = digest GROUP BY rid)
SELECT doc_id, text_digest, license, notices FROM whole LEFT JOIN known ON text_digest = digest LEFT JOIN found USING (rid)
"""
