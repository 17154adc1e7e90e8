"""Licence scan by canonical digests.

A text is canonical without copyright lines, in lower case, with every stretch
of other characters than letters and digits as one space, and with equivalent
spellings made one.  The digest of the entire canonical text, and of each of
its lines as a text of its own, is looked up among the digests of known
licences and notices by a hash join.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_of

# Public licence texts and usual notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NOTICES = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)
#: Full texts in files, by SPDX id (GNU ids without -only and -or-later).
TEXTS = Path(__file__).resolve().parent / "license_texts"
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
#: Names that follow "Licensed under the" and the like in one line; those without a version have ids without one.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"),
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    **{f"{a}-{v}": (f"GNU {n} Public License, version {v[0] if v[2] == '0' else v}", f"GNU {n} Public License, version {v}", f"GNU {n} Public License v{v}", f"GNU {n} Public License {v}", f"GNU {a} {v}", f"{a} {v}", *((f"GNU {n} Public License v{v[0]}", f"GNU {a} v{v[0]}", f"{a}v{v[0]}") if v[2] == "0" else (f"GNU {a} v{v}", f"{a}v{v}"))) for a, n, vs in (("GPL", "General", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General", ("2.1", "3.0")), ("LGPL", "Library General", ("2.0",)), ("AGPL", "Affero General", ("3.0",))) for v in vs},
    "GPL": ("GNU General Public License", "GNU GPL", "GPL"),
    "LGPL": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL"),
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "AGPL"),
    **{f"CC-{c}-4.0": (f"CC {c} 4.0", f"CC {c} 4.0 International", f"Creative Commons {n} 4.0 International License", f"Creative Commons {n} 4.0 License", f"Creative Commons {n} 4.0") for c, n in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License"),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
}
#: Standard headers: (marks of begin and end in the full text).
HEADERS = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "limitations under the License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms", "http://mozilla.org/MPL/2.0/."),
    **dict.fromkeys(("GPL-1.0", "GPL-2.0", "GPL-3.0"), ("This program is free software", "Public License for more details.")),
    **dict.fromkeys(("LGPL-2.0", "LGPL-2.1"), ("This library is free software", "Public License for more details.")),
}
ADDRESS = re.compile(r"51 Franklin (?:St|Street), Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA")
ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")


def forms(text: str) -> list[str]:
    """A full text with other addresses and schemes of links, without its appendix, and without numbers of clauses."""
    out = [text, *(ADDRESS.sub(a, text) for a in ADDRESSES)]
    out += [t.replace("https://", "http://") for t in out] + [t.replace("http://", "https://") for t in out]
    for mark in ("END OF TERMS AND CONDITIONS", "\nExhibit A - Source Code Form License Notice", "\n=======================================================================\n\nCreative Commons is not a party"):
        if mark in text:
            out += [t[: t.index(mark)] for t in out] + ([t[: t.index(mark) + len(mark)] for t in out] if mark.startswith("END") else [])
    return out


def full_texts() -> list[tuple[str, str]]:
    files = {p.stem: p.read_text("utf-8") for p in sorted(TEXTS.glob("*.txt"))}
    out = [(i, form) for i, text in files.items() for form in forms(text)]
    # Texts that come with or without their title.
    for i, titles in (("0BSD", ("Zero-Clause BSD", "BSD Zero Clause License")), ("MIT-0", ("MIT No Attribution",)), ("Zlib", ("The zlib License", "zlib/libpng License"))):
        body = files[i].removeprefix("zlib License\n\n")
        out += [(i, body), *((i, f"{t}\n\n{body}") for t in titles)]
    two = files["BSD-2-Clause"]
    for i, titles, text in (("BSD-2-Clause", NAMES["BSD-2-Clause"], two), ("BSD-3-Clause", NAMES["BSD-3-Clause"], two.replace("\n\nTHIS SOFTWARE", f"\n\n{BSD_3}\n\nTHIS SOFTWARE"))):
        for form in (text, text.replace("HOLDER OR CONTRIBUTORS", "OWNER OR CONTRIBUTORS"), text.replace("COPYRIGHT HOLDER OR", "COPYRIGHT HOLDERS OR")):
            for plain in (form, re.sub(r"(?m)^\d\. ", "* ", form)):
                out += [(i, plain), *((i, f"{prefix}{title}\n\n{plain}") for title in titles for prefix in ("", "The "))]
    for i, (begin, end) in HEADERS.items():
        text = files[i]
        at = text.index(begin, len(text) // 2)
        header = text[at : text.index(end, at) + len(end)]
        out += [(i, header), (i, header.replace("http://", "https://"))]
    return out


def one_liners() -> list[tuple[str, str]]:
    starts = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This file is licensed under", "Available under")
    out = [(i, f"{start} {the}{name}.") for i, names in NAMES.items() for name in names for start in starts for the in ("", "the ")]
    versions = [i for i in NAMES if i not in ("GPL", "LGPL", "AGPL")]
    for i in versions:
        out += [(i, f"SPDX-License-Identifier: {i}{tail}") for tail in (("", "-only", "-or-later", "+") if "GPL" in i else ("",))]
    return out


KNOWN = tuple(dict.fromkeys([*NOTICES, *full_texts(), *one_liners()]))
SPELLINGS = (("licence", "license"), ("favour", "favor"), ("organisation", "organization"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), r"(^|\n)[ \t]*(copyright|\(c\)|all rights reserved)[^\n]*", "\n")
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return out


def catalogue(spark: SparkSession, known=KNOWN) -> DataFrame:
    """license_id and digest of the known texts (as many rows as the fixed list has).

    A text known under two ids keeps both here; the scan takes the smaller one.
    An empty list gives an empty table.
    """
    texts = spark.createDataFrame(list(known), "license_id string, known string")
    return texts.select("license_id", F.sha2(canonical(F.col("known")), 256).alias("digest")).distinct()


#: Rows of a catalogue whose join is broadcast, at most (96 bytes each); a larger one is shuffled.
CATALOGUE_ROWS = 200_000


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_digest, whole_license, n_notices, licenses: one row per document row.

    ``whole_license`` is the licence whose text the whole document is, ``n_notices``
    counts the lines that are a known text by themselves, ``licenses`` lists all
    their ids, sorted, comma-joined ("" if none).  Null text counts as empty; the
    empty canonical text matches nothing; null ids and repeated rows keep a row
    each; an empty table gives an empty result; other columns are ignored.
    ``known`` (license_id, digest) replaces the catalogue.
    """
    known = catalogue(docs.sparkSession) if known is None else known
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy(F.unhex("digest").alias("digest")).agg(F.min("license_id").alias("license_id"))
    known = known.hint("broadcast" if known.count() <= CATALOGUE_ROWS else "shuffle_hash")
    text = text_of(text_col)
    digest = lambda t: F.unhex(F.sha2(canonical(t), 256))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    # The whole text comes first and stays in any case; the lines are joined and only those that are known go on.
    rows = rows.select("row", "doc_id", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("place", "part"))
    rows = rows.select("row", "doc_id", (F.col("place") == 0).alias("whole"), digest(F.col("part")).alias("digest"))
    met = rows.join(known, "digest", "left").where(F.col("whole") | F.col("license_id").isNotNull())
    whole = F.col("whole")
    out = met.groupBy("row").agg(
        F.max(F.when(whole, F.struct("doc_id"))).alias("d"),
        F.max(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.max(F.when(whole, F.col("license_id"))).alias("whole_license"),
        F.count_if(~whole).alias("n_notices"),
        F.collect_set("license_id").alias("ids"),
    )
    return out.select("d.doc_id", F.lower(F.hex("text_digest")).alias("text_digest"), F.coalesce("whole_license", F.lit("")).alias("whole_license"), "n_notices", F.array_join(F.array_sort("ids"), ",").alias("licenses"))
