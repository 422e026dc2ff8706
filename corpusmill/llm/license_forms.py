"""What licences look like in files: names, statements, SPDX tags, headers and full texts (license_texts/)."""

from __future__ import annotations

from pathlib import Path

_GNU = "it under the terms of the GNU {0}General Public License as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
_GNU_REST = "This {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
_GNU_COPY = "You should have received a copy of the GNU {0}General Public License along with this {2}. If not, see <https://www.gnu.org/licenses/>."


def _gnu(kind: str, version: str, day: str, short: str, what: str = "program") -> tuple:
    full = f"GNU {kind}General Public License"
    first = f"This {what} is free software; you can redistribute it and/or modify " + _GNU.format(kind, version)
    header = " ".join([first, _GNU_REST.format(kind, version, what), _GNU_COPY.format(kind, version, what)])
    ids = tuple(f"{short}-{v}{end}" for v in {version, f"{version}.0" if "." not in version else version} for end in ("", "-only", "-or-later"))
    return ids, (full + f", version {version}", full + f" v{version}", f"{full} Version {version}, {day}", f"{short} {version}", f"{short}v{version}"), (first, header, f"{full} version {version} or later")


#: Of each licence its SPDX ids, its names, and other statements and headers.
_KNOWN = {
    "MIT": (("MIT",), ("MIT License", "The MIT License (MIT)", "Expat License"), ()),
    "Apache-2.0": (
        ("Apache-2.0",),
        ("Apache License", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Apache 2.0 License"),
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
            'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
            "See the License for the specific language governing permissions and limitations under the License.",
        ),
    ),
    "BSD-2-Clause": (("BSD-2-Clause",), ("BSD 2-Clause License", "Simplified BSD License"), ()),
    "BSD-3-Clause": (("BSD-3-Clause",), ("BSD 3-Clause License", "New BSD License", "Modified BSD License"), ("Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.")),
    "ISC": (("ISC",), ("ISC License",), ()),
    "GPL-2.0": _gnu("", "2", "June 1991", "GPL"),
    "GPL-3.0": _gnu("", "3", "29 June 2007", "GPL"),
    "LGPL-2.1": _gnu("Lesser ", "2.1", "February 1999", "LGPL", "library"),
    "LGPL-3.0": _gnu("Lesser ", "3", "29 June 2007", "LGPL", "library"),
    "AGPL-3.0": _gnu("Affero ", "3", "19 November 2007", "AGPL"),
    "MPL-2.0": (
        ("MPL-2.0",),
        ("Mozilla Public License", "Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ),
    "CC0-1.0": (("CC0-1.0",), ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"), ()),
    "Unlicense": (("Unlicense",), ("The Unlicense",), ("This is free and unencumbered software released into the public domain.",)),
}
_KNOWN |= {
    f"CC-{k}-4.0": ((f"CC-{k}-4.0",), (f"CC {k} 4.0", f"Creative Commons {full} 4.0 International", f"Creative Commons {full} 4.0 International Public License", f"Creative Commons {full} 4.0 International License"), (f"Licensed under CC {k} 4.0.",))
    for k, full in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
}


def _forms(name: str) -> tuple[str, ...]:
    ids, names, more = _KNOWN[name]
    said = [f"{verb} {n}." for n in names for verb in ("Licensed under the", "Released under the", "This work is licensed under the")]
    file = Path(__file__).parent / "license_texts" / f"{name}.txt"
    full = [file.read_text()] if file.exists() else []
    return tuple(dict.fromkeys([*(f"SPDX-License-Identifier: {i}" for i in sorted(ids)), *names, *said, *more, *full]))


FORMS: dict[str, tuple[str, ...]] = {name: _forms(name) for name in _KNOWN}
