"""Known licence texts: whole public texts (``license_texts/``) and notices by the names of each licence."""

from __future__ import annotations

from pathlib import Path

_TEXTS = Path(__file__).parent / "license_texts"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_FSF = "51 Franklin Street, Fifth Floor, Boston, MA", "59 Temple Place, Suite 330, Boston, MA"


def _read(name: str) -> str:
    return (_TEXTS / f"{name}.txt").read_text(encoding="utf-8")


def _without_end(text: str) -> list[str]:
    """The text, and it without what follows its terms, with and without the line that ends them."""
    end = "END OF TERMS AND CONDITIONS"
    if end not in text:
        return [text]
    terms = text[:text.index(end)]
    return [text, terms + end, terms]


def _bsd(text: str, licence: str, titles: tuple[str, ...]) -> list[tuple[str, str]]:
    """With and without title, conditions numbered or marked by a bullet or letter."""
    clauses = [text]
    for marks in (("", "", ""), ("a", "b", "c"), ("i", "ii", "iii")):
        other = text
        for number, mark in zip("123", marks, strict=True):
            other = other.replace(f"{number}. ", f"{mark} ", 1)
        clauses.append(other)
    return [(licence, f"{title}\n\n{c[c.index('Redistribution and use'):]}") for c in clauses for title in ("", *titles)]


def whole_texts() -> list[tuple[str, str]]:
    found = []
    for name in sorted(p.stem for p in _TEXTS.glob("*.txt")):
        if name.startswith("BSD"):
            continue
        licence = name.removesuffix(".spdx")
        for text in _without_end(_read(name)):
            for one in dict.fromkeys((text, text.replace(*_FSF), text.replace("https://", "http://"), text.replace(*_FSF).replace("https://", "http://"))):
                found.append((licence, one))
    two, university = _read("BSD-2-Clause"), _read("BSD-3-Clause")
    at = two.index("THIS SOFTWARE IS PROVIDED")
    found += _bsd(two, "BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"))
    for three in (two[:at] + _BSD_3 + two[at:], university):
        found += _bsd(three, "BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"))
    return found


_LATER = (" or later", ", or later", " or any later version", ", or (at your option) any later version")


def _gnu(licence: str, titles: tuple[str, ...], short: str, version: str) -> dict[str, list[str]]:
    numbers = {version, version.removesuffix(".0")}
    names = [f"{t}{gap}{n}" for t in titles for n in sorted(numbers) for gap in (", version ", " ")]
    names += [f"GNU {short} version {n}" for n in sorted(numbers)] + [f"{short} version {n}" for n in sorted(numbers)]
    names += [f"{g}{short}{gap}{n}" for g in ("", "GNU ") for gap in ("v", " ") for n in sorted(numbers)]
    later = [n + tail for n in names for tail in _LATER]
    return {licence: names, f"{licence}-or-later": [*later, *(f"{short}{gap}{n}+" for gap in ("v", " ") for n in sorted(numbers) if n != version or version == "2.1")]}


def _creative_commons() -> dict[str, list[str]]:
    found = {}
    parts = {"BY": ["Attribution"], "SA": ["ShareAlike", "Share Alike"], "NC": ["NonCommercial", "Non Commercial"], "ND": ["NoDerivatives", "No Derivatives", "NoDerivs"]}
    for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        titles = [""]
        for part in code.split("-"):
            titles = [f"{t}-{p}".lstrip("-") for t in titles for p in parts[part]]
        for version, places in (("4.0", (" International",)), ("3.0", (" Unported",)), ("2.5", (" Generic",)), ("2.0", (" Generic",)), ("1.0", (" Generic",))):
            names = [f"{cc}{t} {version}{place}{end}" for cc in ("Creative Commons ", "Creative Commons license ") for t in titles for place in ("", *places) for end in ("", " License", " Public License")]
            names += [f"Creative Commons {t} License {version}" for t in titles]
            names += [f"{cc} {code} {version}{place}{end}" for cc in ("CC", "Creative Commons") for place in ("", *places) for end in ("", " License")]
            found[f"CC-{code}-{version}"] = names
    return found


#: Names that notices give a licence, each also with other spellings that the canonical form makes equal.
NAMES = {
    "MIT": ["MIT License", "MIT", "Expat License", "MIT/X11 License", "MIT License (MIT)"],
    "ISC": ["ISC License", "ISC"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache 2 License", "Apache v2.0 License", "Apache Software License, Version 2.0", "Apache Software License 2.0", 'Apache License, Version 2.0 (the "License")', 'Apache License, Version 2.0 (the "License");'],
    **_gnu("GPL-1.0", ("GNU General Public License",), "GPL", "1.0"),
    **_gnu("GPL-2.0", ("GNU General Public License",), "GPL", "2.0"),
    **_gnu("GPL-3.0", ("GNU General Public License",), "GPL", "3.0"),
    **_gnu("LGPL-2.0", ("GNU Library General Public License", "GNU Lesser General Public License"), "LGPL", "2.0"),
    **_gnu("LGPL-2.1", ("GNU Lesser General Public License",), "LGPL", "2.1"),
    **_gnu("LGPL-3.0", ("GNU Lesser General Public License",), "LGPL", "3.0"),
    **_gnu("AGPL-3.0", ("GNU Affero General Public License",), "AGPL", "3.0"),
    "GFDL-1.2": ["GNU Free Documentation License, Version 1.2", "GNU Free Documentation License 1.2", "GFDL 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3", "GNU Free Documentation License 1.3", "GFDL 1.3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause", "2-Clause BSD License", "2-clause BSD", "Simplified BSD License", "FreeBSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause", "3-Clause BSD License", "3-clause BSD", "New BSD License", "Modified BSD License", "Revised BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1", "MPL version 1.1", "MPLv1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL version 2.0", "MPLv2.0", "MPLv2"],
    **_creative_commons(),
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "CC0 License", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero 1.0", "Creative Commons CC0 License"],
}
def notices() -> list[tuple[str, str]]:
    """Every licence name in a sentence, whose beginning the canonical form makes equal to others, and SPDX identifiers."""
    found = []
    for licence, names in NAMES.items():
        for name in dict.fromkeys(names):
            found.append((licence, f"Licensed under {name}."))
            found.append((licence, f"License: {name}"))
        found.append((licence, f"SPDX-License-Identifier: {licence}"))
        if "GPL" in licence and not licence.endswith("-or-later"):
            found += [(licence, f"SPDX-License-Identifier: {licence}-only"), (f"{licence}-or-later", f"SPDX-License-Identifier: {licence}+")]
        if licence.startswith("CC-BY"):
            code, version = licence[3:].lower().rsplit("-", 1)
            found += [(licence, f"{begin}{web}://creativecommons.org/licenses/{code}/{version}/") for web in ("http", "https") for begin in ("", "To view a copy of this license, visit ")]
            found += [(licence, f"{licence[:-len(version) - 1].replace('-', ' ', 1)} {version}")]
    return found
