"""Fixed values for the license scan: headers, statements and short whole texts of the usual SPDX licenses.

A name is the SPDX identifier and, after ~, which of the license's texts this is.
"""

from __future__ import annotations

#: Identifiers sought as SPDX tags and (with a common name) as one-line statements.
SPDX = ("0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 "
        "CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-3.0 "
        "CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 "
        "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 PostgreSQL Unlicense WTFPL Zlib").split()

NAMED = {"Apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache License Version 2.0"], "MIT": ["MIT License"], "ISC": ["ISC License"],
         "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
         "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0"], "EPL-2.0": ["Eclipse Public License 2.0"],
         "EPL-1.0": ["Eclipse Public License 1.0"], "Zlib": ["zlib License"], "BSL-1.0": ["Boost Software License Version 1.0"],
         "GPL-2.0": ["GNU General Public License v2.0", "GPL v2", "GPLv2"], "GPL-3.0": ["GNU General Public License v3.0", "GPL v3", "GPLv3"],
         "LGPL-2.1": ["LGPL v2.1", "LGPLv2.1"], "LGPL-3.0": ["LGPL v3", "LGPLv3"], "AGPL-3.0": ["AGPL v3", "AGPLv3"], "Unlicense": ["Unlicense"]}

_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}


def _commons() -> dict[str, str]:
    out = {}
    for name in (x for x in SPDX if x.startswith("CC-")):
        kinds, version = name.split("-")[1:-1], name.split("-")[-1]
        where = "International" if version == "4.0" else "Unported"
        for long in {"-".join(_PARTS[k] for k in kinds), "-".join({"NC": "Non-Commercial", "SA": "Share-Alike"}.get(k, _PARTS[k]) for k in kinds)}:
            out[f"{name}~{long.lower()}"] = f"licensed under a Creative Commons {long} {version} {where} License"
            out[f"{name}~the-{long.lower()}"] = f"licensed under the Creative Commons {long} {version} {where} License"
        for verb in ("licensed", "released", "available"):
            out[f"{name}~{verb}"] = f"{verb} under CC {'-'.join(kinds)} {version}"
    return out


_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

TEXTS = {
    **{f"{x}~spdx": f"SPDX-License-Identifier: {x}" for x in SPDX},
    **{f"{x}~{verb}-{k}": f"{verb} under {the}{n}" for x, names in NAMED.items() for k, n in enumerate(names)
       for verb in ("licensed", "released", "distributed", "available") for the in ("the ",)},
    **_commons(),
    "BSD-2-Clause~text": _BSD + " THIS SOFTWARE IS PROVIDED BY",
    "BSD-3-Clause~text": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
    "ISC~text": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD~text": _ISC + ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    "Unlicense~text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
    "any means.",
    "CC0-1.0~notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
    "software to the public domain worldwide. This software is distributed without any warranty.",
    "CC0-1.0~licensed": "licensed under CC0 1.0", "CC0-1.0~released": "released under CC0 1.0", "CC0-1.0~name": "CC0 1.0 Universal",
    "BSL-1.0~notice": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0~notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
    "available at",
    "EPL-1.0~notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
    "accompanies this distribution, and is available at",
    "Zlib~text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "OFL-1.1~notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}

#: Phrases, five words at most, without which a text isn't stated.
DECIDE = {"BSD-2-Clause~text": ["in binary form must reproduce", "the distribution this software is"], "BSD-3-Clause~text": ["to endorse or promote products"],
          "ISC~text": ["this permission notice appear in"], "0BSD~text": ["hereby granted the software is"], "Unlicense~text": ["free and unencumbered software"],
          "CC0-1.0~notice": ["to the public domain"], "EPL-2.0~notice": ["eclipse public license 2 0"], "EPL-1.0~notice": ["eclipse public license v1 0"],
          "BSL-1.0~notice": ["boost software license version 1"], "OFL-1.1~notice": ["sil open font license version"],
          "Zlib~text": ["alter it and redistribute it"]}
