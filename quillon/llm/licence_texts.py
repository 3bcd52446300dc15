"""Public licence texts and notices that the license scan knows.

All are fixed values: the wording of the licences, without their copyright lines, names by which
notices call them, and for the longest texts the digests of their canonical forms.
"""

from __future__ import annotations

AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
IN_NO_EVENT = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
MIT = f"""{GRANT}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{AS_IS} AND NONINFRINGEMENT. {IN_NO_EVENT}"""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = f"""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

{AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""


def _gnu(name: str, version: str, what: str) -> str:
    """The notice that the GNU licences ask for."""
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\n"
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\n"
        f"You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


def _bsd(*conditions: str) -> list[str]:
    """The conditions numbered, with an asterisk each, and numbered in brackets."""
    return ["\n".join([BSD_HEAD, *(mark.format(k + 1) + c for k, c in enumerate(conditions)), BSD_TAIL]) for mark in ("{}. ", "* ")]


#: (licence, titles, texts): a text is known with each of the titles and without.
TEXTS = [
    ("mit", ["MIT License", "The MIT License", "The MIT License (MIT)"], [MIT]),
    ("mit-0", ["MIT No Attribution", "MIT No Attribution License"], [f"{GRANT}.\n\n{AS_IS} AND NONINFRINGEMENT. {IN_NO_EVENT}"]),
    ("bsd-2-clause", ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"], _bsd(BSD_1, BSD_2)),
    ("bsd-3-clause", ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License"], _bsd(BSD_1, BSD_2, BSD_3)),
    ("isc", ["ISC License", "The ISC License", "ISC License (ISC)"], [f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_TAIL}"]),
    ("0bsd", ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License"], [f"{ISC_GRANT}.\n\n{ISC_TAIL}"]),
    ("zlib", ["zlib License", "The zlib License", "The zlib/libpng License"], [ZLIB]),
    ("bsl-1.0", ["Boost Software License - Version 1.0 - August 17th, 2003"], [BSL]),
    ("unlicense", ["The Unlicense", "Unlicense"], [UNLICENSE, UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>", UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>"]),
    ("wtfpl", ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"], [WTFPL]),
    ("apache-2.0", [], [APACHE_HEADER]),
    ("mpl-2.0", [], [MPL_HEADER]),
    *((spdx, [], [_gnu(name, version, what) for what in ("program", "file", "library")]) for spdx, name, version in [
        ("gpl-2.0", "GNU General Public License", "2"), ("gpl-3.0", "GNU General Public License", "3"), ("agpl-3.0", "GNU Affero General Public License", "3"),
        ("lgpl-2.1", "GNU Lesser General Public License", "2.1"), ("lgpl-3.0", "GNU Lesser General Public License", "3"),
    ]),
]

#: Names by which one-line notices call a licence, besides its SPDX identifier.
NAMES = [
    ("mit", ["the MIT License", "the MIT license (MIT)", "MIT"]),
    ("apache-2.0", ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "Apache-2.0"]),
    ("bsd-2-clause", ["the BSD 2-Clause License", "the 2-clause BSD license", "the Simplified BSD License", "BSD-2-Clause"]),
    ("bsd-3-clause", ["the BSD 3-Clause License", "the 3-clause BSD license", "the New BSD License", "BSD-3-Clause"]),
    ("isc", ["the ISC License", "ISC"]),
    ("zlib", ["the zlib License", "the zlib/libpng License"]),
    ("bsl-1.0", ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"]),
    ("unlicense", ["the Unlicense"]),
    ("mpl-2.0", ["the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0", "MPL 2.0"]),
    ("epl-2.0", ["the Eclipse Public License, Version 2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v2.0"]),
    ("gpl-2.0", ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL, version 2", "the GPL, version 2", "GPLv2"]),
    ("gpl-3.0", ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL, version 3", "the GPL, version 3", "GPLv3"]),
    ("agpl-3.0", ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPLv3"]),
    ("lgpl-2.1", ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "LGPLv2.1"]),
    ("lgpl-3.0", ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "LGPLv3"]),
    ("cc0-1.0", ["CC0", "CC0 1.0", "CC0 1.0 Universal"]),
    ("cc-by-4.0", ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "a Creative Commons Attribution 4.0 International License"]),
    ("cc-by-sa-4.0", ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "a Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("cc-by-nd-4.0", ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License", "a Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    ("cc-by-nc-4.0", ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "a Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("cc-by-nc-sa-4.0", ["CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    ("cc-by-nc-nd-4.0", ["CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"]),
    ("cc-by-3.0", ["CC BY 3.0", "the Creative Commons Attribution 3.0 Unported License", "a Creative Commons Attribution 3.0 Unported License"]),
    ("cc-by-sa-3.0", ["CC BY-SA 3.0", "the Creative Commons Attribution-ShareAlike 3.0 Unported License", "a Creative Commons Attribution-ShareAlike 3.0 Unported License"]),
]
WAYS = ["Licensed", "Released", "Distributed", "Published", "Available", *(f"This {x} is {y}" for x in ("work", "project", "software", "program", "file", "code", "library", "package", "content", "document") for y in ("licensed", "released", "distributed"))]
UNDER = ["under", "under the terms of"]

#: Digests of canonical whole texts as their stewards publish them, title and appendix included.
DIGESTS = [
    ("apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("artistic-1.0-perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("cc0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("gfdl-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("gfdl-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("gpl-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("gpl-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("gpl-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("lgpl-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("lgpl-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("lgpl-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("mpl-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("mpl-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]


def notices() -> list[tuple[str, str]]:
    """All known texts as (licence, text)."""
    out = [(spdx, f"{title}\n\n{text}" if title else text) for spdx, titles, texts in TEXTS for text in texts for title in ("", *titles)]
    out += [(spdx, f"{way} {under} {name}") for spdx, names in NAMES for name in names for way in WAYS for under in UNDER]
    spdx = sorted({spdx for spdx, *_ in [*TEXTS, *NAMES, *DIGESTS]})
    return out + [(x, f"SPDX-License-Identifier: {x}{more}") for x in spdx for more in ("", *(("-only", "-or-later") if "gpl" in x else ()))]
