"""The wording of licenses and license notices, as their publishers give it."""

TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.""",
    "Apache-2.0 text": """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS
FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use,
reproduction, and distribution as defined by Sections 1 through 9 of this document.""",
    "MPL-2.0 text": """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or
legal entity that creates, contributes to the creation of, or owns Covered Software.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0 text": """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation,
Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not
allowed.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All rights reserved": "All rights reserved.",
}

# The same wordings of other versions and variants.
for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
    for _variant in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        TEMPLATES.setdefault(f"CC-{_variant}-{_version}", f"Licensed under CC {_variant} {_version}.")
for _version in ("1.0", "1.1"):
    TEMPLATES[f"Apache-{_version}"] = f"Licensed under the Apache License, Version {_version}."
_GPL, _GPL_HEADER = TEMPLATES["GPL-3.0"], TEMPLATES["GPL-3.0 header"].replace("\n", " ")
for _name, _kind, _version in (
    ("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("LGPL-2.0", "Lesser ", "2"), ("LGPL-2.1", "Lesser ", "2.1"),
    ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
):
    for _text, _suffix in ((_GPL, ""), (_GPL_HEADER, " header")):
        _text = _text.replace("GNU General", f"GNU {_kind}General").replace("version 3", f"version {_version}")
        TEMPLATES[_name + _suffix] = _text
for _name, _kind in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")):  # no version given
    TEMPLATES[_name] = f"This work is licensed under the GNU {_kind}General Public License"
    for _version in ("2", "3"):
        TEMPLATES[f"{_name}-{_version}.0 notice"] = f"{TEMPLATES[_name]} v{_version}"
_NOTICE = TEMPLATES["CC-BY-4.0 notice"]
for _variant, _kind in (
    ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"),
    ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"),
):
    TEMPLATES[f"CC-{_variant}-4.0 notice"] = _NOTICE.replace("Attribution", f"Attribution{_kind}")
_TEXT = TEMPLATES["GPL-3.0 text"].replace("\n", " ")
for _name, _kind, _version in (
    ("GPL-2.0", "", "2, June 1991"), ("LGPL-2.1", "Lesser ", "2.1, February 1999"), ("LGPL-3.0", "Lesser ", "3, 29 June 2007"),
    ("AGPL-3.0", "Affero ", "3, 19 November 2007"),
):
    TEMPLATES[f"{_name} text"] = _TEXT.replace("GNU ", f"GNU {_kind}").replace("3, 29 June 2007", _version)
for _name in (
    "MIT", "ISC", "Zlib", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
):
    TEMPLATES[f"{_name} identifier"] = f"SPDX-License-Identifier: {_name}"
