"""Licence texts and notices that license scans look for, by SPDX-like name.

Complete texts and headers are files of license_texts; "-start" names beginnings that documents may have alone.
"""

import os

TEMPLATES = {
    "MIT": " ".join([
        "Permission is hereby granted, free of charge, to any",
        "person obtaining a copy of this software and associated",
        "documentation files (the Software), to deal in the Software",
        "without restriction, including without limitation the rights to",
        "use, copy, modify, merge,",
        "publish, distribute, sublicense,",
        "and/or sell copies of the Software, and to permit persons",
        "to whom the Software is furnished to do so,",
        "subject to the following conditions:",
        "The above copyright notice and this permission notice shall",
        "be included in all copies or substantial portions of",
        "the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF",
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED",
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR",
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS",
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES",
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,",
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN",
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER",
        "DEALINGS IN THE SOFTWARE.",
    ]),
    "BSD-3-Clause-start": " ".join([
        "Redistribution and use in source and binary forms, with",
        "or without modification, are permitted provided that the following",
        "conditions are met: Redistributions of source code must retain",
        "the above copyright notice, this list of conditions and",
        "the following disclaimer. Redistributions in binary form must reproduce",
        "the above copyright notice, this list of conditions and",
        "the following disclaimer in the documentation and/or other materials",
        "provided with the distribution. Neither the name of the",
        "copyright holder nor the names of its contributors may",
        "be used to endorse or promote products derived from",
        "this software without specific prior written permission.",
    ]),
    "BSD-2-Clause-start": " ".join([
        "Redistribution and use in source and binary forms, with",
        "or without modification, are permitted provided that the following",
        "conditions are met: Redistributions of source code must retain",
        "the above copyright notice, this list of conditions and",
        "the following disclaimer. Redistributions in binary form must reproduce",
        "the above copyright notice, this list of conditions and",
        "the following disclaimer in the documentation and/or other materials",
        "provided with the distribution.",
    ]),
    "ISC-start": " ".join([
        "Permission to use, copy, modify, and/or distribute this software",
        "for any purpose with or without fee is hereby",
        "granted, provided that the above copyright notice and this",
        "permission notice appear in all copies.",
    ]),
    "Zlib-start": " ".join([
        "This software is provided as-is, without any express or",
        "implied warranty. In no event will the authors be",
        "held liable for any damages arising from the use",
        "of this software. Permission is granted to anyone to",
        "use this software for any purpose, including commercial applications,",
        "and to alter it and redistribute it freely.",
    ]),
    "Unlicense-start": " ".join([
        "This is free and unencumbered software released into the",
        "public domain. Anyone is free to copy, modify, publish,",
        "use, compile, sell, or distribute this software, either in",
        "source code form or as a compiled binary, for",
        "any purpose, commercial or non-commercial, and by any means.",
    ]),
    "Apache-2.0-header": " ".join([
        "Licensed under the Apache License, Version 2.0 (the License);",
        "you may not use this file except in compliance",
        "with the License. You may obtain a copy of",
        "the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in",
        "writing, software distributed under the License is distributed on",
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF",
        "ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions",
        "and limitations under the License.",
    ]),
    "GPL-3.0-header-start": " ".join([
        "This program is free software: you can redistribute it",
        "and/or modify it under the terms of the GNU",
        "General Public License as published by the Free Software",
        "Foundation, either version 3 of the License, or (at",
        "your option) any later version.",
        "This program is distributed in the hope that it",
        "will be useful, but WITHOUT ANY WARRANTY; without even",
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A",
        "PARTICULAR PURPOSE.",
    ]),
    "MPL-2.0-header": " ".join([
        "This Source Code Form is subject to the terms",
        "of the Mozilla Public License, v. 2.0. If a",
        "copy of the MPL was not distributed with this",
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ]),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
for _file in sorted(os.listdir(FOLDER)):
    with open(os.path.join(FOLDER, _file), encoding="utf-8") as _f:
        TEMPLATES[_file.removesuffix(".txt")] = _f.read()
for _name in ("GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
    TEMPLATES[f"{_name}-header-start"] = TEMPLATES[f"{_name}-header"].partition("PURPOSE.")[0] + "PURPOSE."
