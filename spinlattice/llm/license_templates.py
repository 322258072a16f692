"""Public license texts, headers and short notices, by name.

Whole texts of long licenses are files in ``license_texts`` (copies of Debian's common-licenses); their
headers and the short licenses are here. A template names what a text holds: a BSD 3-clause text is
reported for the 2-clause text and for the clause on names. Parts have their own templates because a
whole text is only reported from 0.8 of its shingles on. The GNU family and its version
(``gnu-3-or-later``) are templates of their own, each so short that another family or version stays below
0.8 of them. AGPL has a header and titles, Creative Commons (but CC0) titles and notices, without whole texts.
"""

from __future__ import annotations

from pathlib import Path

MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement"
BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

# fixed values: public license notices
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit": MIT_GRANT,
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": BSD_GRANT,
    "isc": ISC_GRANT,
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-conditions": MIT_NOTICE,
    "mit-disclaimer": MIT_AS_IS,
    "mit-text": f"{MIT_GRANT}: {MIT_NOTICE} {MIT_AS_IS}",
    "bsd-conditions": BSD_TWO,
    "bsd-3-clause-names": BSD_NAMES,
    "bsd-advertising": BSD_ADVERTISING,
    "bsd-disclaimer": BSD_AS_IS,
    "bsd-2-clause-text": f"{BSD_GRANT}: {BSD_TWO} {BSD_AS_IS}",
    "isc-disclaimer": ISC_AS_IS,
    "isc-text": f"{ISC_GRANT} {ISC_AS_IS}",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mpl-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "mit-style-notice": "Use of this source code is governed by an MIT-style license",
    "bsd-style-notice": "Use of this source code is governed by a BSD-style license",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc0-1.0-dedication": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "all-rights-reserved-permission": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}

GNU = {"gpl": ("General", ("2", "3")), "lgpl": ("Lesser General", ("2.1", "3")), "lgpl-library": ("Library General", ("2",)), "agpl": ("Affero General", ("3",))}
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

for _name, (_kind, _versions) in GNU.items():
    TEMPLATES[f"{_name}-header"] = f"terms of the GNU {_kind} Public License as published by"
    for _v in _versions:
        _id = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES[f"{_id}-only-header"] = f"the terms of the GNU {_kind} Public License version {_v} as published by the Free Software Foundation"
        TEMPLATES[f"{_id}-title"] = f"GNU {_kind} Public License, version {_v}"
for _v in ("2", "2.1", "3"):
    TEMPLATES[f"gnu-{_v}-or-later"] = f"either version {_v} of the License, or (at your option) any later version"

TEMPLATES["mit-licensed"] = "Licensed under the MIT License."
TEMPLATES["apache-2.0-released"] = "Released under the Apache License, Version 2.0."
for _name in ("2", "3"):
    TEMPLATES[f"bsd-{_name}-clause-notice"] = f"Licensed under the BSD {_name}-Clause License."
    TEMPLATES[f"bsd-{_name}-clause-released"] = f"Released under the BSD {_name}-Clause License."
TEMPLATES["mpl-2.0-notice"] = "Licensed under the Mozilla Public License, version 2.0."

for _code, _title in CC.items():
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _scope = "International" if _v == "4.0" else "Unported" if _v == "3.0" else "Generic"
        TEMPLATES[f"cc-{_code}-{_v}-notice"] = f"Licensed under CC {_code.upper()} {_v}."
        TEMPLATES[f"cc-{_code}-{_v}-released"] = f"Released under CC {_code.upper()} {_v}."
        TEMPLATES[f"cc-{_code}-{_v}-title"] = f"Creative Commons {_title} {_v} {_scope}"

for _path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES[f"{_path.stem}-text"] = _path.read_text()
