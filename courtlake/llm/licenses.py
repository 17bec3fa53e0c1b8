"""Known licence texts, one-line notices and equivalent spellings (fixed values).

The longer texts are files of ``license_texts``, read on the driver only.
"""

from __future__ import annotations

import itertools
import re
from pathlib import Path

_FILES = Path(__file__).with_name("license_texts")

#: Spellings that the SPDX matching guidelines treat alike, as variant -> canonical.
SPELLINGS = {
    "licence": "license",
    "acknowledgement": "acknowledgment",
    "authorisation": "authorization",
    "authorised": "authorized",
    "organisation": "organization",
    "favour": "favor",
    "honour": "honor",
    "fulfilment": "fulfillment",
    "judgement": "judgment",
    "merchantibility": "merchantability",
    "modernisation": "modernization",
    "sub-license": "sublicense",
    "noninfringement": "non-infringement",
    "http://": "https://",
}

#: One-line notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}

_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""

_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""

_ISC_GRANT = """
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""

_ISC_DISCLAIMER = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""

_BSD_START = """
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""

_APACHE_HEADER = """
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""

#: Title lines of licences whose text above has none; the first is the usual one.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
    "BSD-3-Clause (University)": ("BSD License", "BSD 3-Clause License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: What the whole texts begin with and copies leave out, as patterns; each entry goes with those before it.
_HEADS = {
    "Apache-2.0": (r"Apache License\s+Version 2\.0, January 2004\s+http://www\.apache\.org/licenses/",),
    "Artistic-1.0-Perl": (r"The \"Artistic License\"",),
    "BSL-1.0": (r"Boost Software License - Version 1\.0 - August 17th, 2003",),
    "CC0-1.0": (r"Creative Commons Legal Code", r"CC0 1\.0 Universal", r"CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM.*?HEREUNDER\.(?=\s+Statement)"),
    "MPL-1.1": (r"MOZILLA PUBLIC LICENSE\s+Version 1\.1\s+-+",),
    "MPL-2.0": (r"Mozilla Public License Version 2\.0\s+=+",),
    **{f"GFDL-{v}": (r"GNU Free Documentation License\s+Version 1\.\d, [^\n]*",) for v in ("1.2", "1.3")},
    **{f"{x}GPL-{v}": (r"GNU [A-Z ]*PUBLIC LICENSE\s+Version [^\n]*",) for x, v in (("", "1.0"), ("", "2.0"), ("", "3.0"), ("L", "2.0"), ("L", "2.1"), ("L", "3.0"))},
}
#: From here on a text only says how to apply it, and copies leave it out.
_APPENDIX = re.compile(r"\n[ \t]*(?:(?:APPENDIX|Appendix|ADDENDUM): )?How to (?:apply the Apache License|Apply These Terms|use this License).*", re.S)
_END = re.compile(r"\n[ \t]*END OF TERMS AND CONDITIONS\s*$")
#: The Free Software Foundation's addresses, as its texts of different years give them.
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
    "675 Mass Ave, Cambridge, MA 02139, USA",
)


def _forms(license_id: str, text: str) -> dict[str, str]:
    """A whole text as it is, without its title, without its appendix, and with each address."""
    heads, rest = {"": text}, text
    for k, pattern in enumerate(_HEADS.get(license_id, ())):
        rest, found = re.subn(r"^\s*" + pattern, "", rest, count=1, flags=re.S if k else 0)
        if not found:
            raise ValueError(f"{license_id} does not begin with {pattern}")
        heads["no title" if k == 0 else f"no title {k + 1}"] = rest
    out = {}
    for (head, t), address in itertools.product(heads.items(), ("", *_ADDRESSES) if _ADDRESS.search(text) else ("",)):
        t = _ADDRESS.sub(address, t) if address else t
        short = _APPENDIX.sub("", t)
        ends = {"": t} | ({"no appendix": short, "no appendix, no end line": _END.sub("", short)} if short != t else {})
        for end, whole in ends.items():
            about = ", ".join(filter(None, (head, end, address)))
            out[f"{license_id} ({about})" if about else license_id] = whole
    return out


def _titled(license_id: str, text: str) -> dict[str, str]:
    titles = TITLES.get(license_id, ())
    return {f"{license_id} (title {k})": f"{title}\n{text}" for k, title in enumerate(titles, 1)}


_PLAIN = {
    "MIT": _MIT + _AS_IS,
    "ISC": _ISC_GRANT + ", provided that the above\ncopyright notice and this permission notice appear in all copies.\n" + _ISC_DISCLAIMER,
    "0BSD": _ISC_GRANT + ".\n" + _ISC_DISCLAIMER,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + _BSD_THIRD + _BSD_END,
    "Zlib": _ZLIB,
}
_WHOLE = {f.stem: f.read_text("utf-8") for f in sorted(_FILES.glob("*.txt"))}

#: Whole licence texts, with and without their title line, and notices that stand alone.
FULL_TEXTS = {
    **{k: v for name, text in _WHOLE.items() for k, v in _forms(name, text).items()},
    **{k: v for name, text in (_PLAIN | _WHOLE).items() for k, v in _titled(name, text).items()},
    **_PLAIN,
    "MIT": f"{TITLES['MIT'][0]}\n{_PLAIN['MIT']}",
    "MIT (no title)": _PLAIN["MIT"],
    "ISC": f"{TITLES['ISC'][0]}\n{_PLAIN['ISC']}",
    "ISC (no title)": _PLAIN["ISC"],
    "Apache-2.0 (header)": _APACHE_HEADER,
    **{f"{k} (notice)": v for k, v in NOTICES.items()},
}
