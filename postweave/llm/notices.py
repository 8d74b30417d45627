"""Licence notices that the licence scan looks for, as a table of plain texts."""

from __future__ import annotations

import re
from typing import NamedTuple

WORD = re.compile("[a-z0-9]+")


class Notice(NamedTuple):
    """A notice: its label, its text, and the phrases of it that must stand in a file."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return WORD.findall(self.text.lower())

    @property
    def phrases(self) -> list[list[int]]:
        """The positions of each key phrase."""
        words, found = self.words, []
        for key in self.keys:
            parts = WORD.findall(key.lower())
            starts = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
            if not parts or not starts:
                raise ValueError(f"the key phrase does not stand in its notice: {key!r}")
            found.append(list(range(starts[0], starts[0] + len(parts))))
        return found


_GNU = ("This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
        "as published by the Free Software Foundation; either version {version} of the License, or (at your option) any "
        "later version. This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} "
        "for more details. You should have received a copy of the GNU {name} along with this {kind}")


def _gnu(label: str, kind: str, name: str, version: str) -> Notice:
    return Notice(label, _GNU.format(kind=kind, name=name, version=version), (f"under the terms of the GNU {name}", f"either version {version} of the License"))


def _commons(label: str, terms: str) -> Notice:
    return Notice(label, f"This work is licensed under a Creative Commons {terms} 4.0 International License.",
                  (f"Creative Commons {terms} 4.0 International",))


_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.")

# Well-known licence notices, each with the phrases that no file under it lacks.
NOTICES = [
    Notice("gpl", "This work is licensed under the GNU General Public License version 2",
           ("licensed under the GNU General Public License version 2",)),
    Notice("gpl-3", "This work is licensed under the GNU General Public License version 3",
           ("licensed under the GNU General Public License version 3",)),
    Notice("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation", ("under the terms of the GNU General Public License",)),
    _gnu("gpl-2", "program", "General Public License", "2"),
    _gnu("gpl-3", "program", "General Public License", "3"),
    Notice("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
           "General Public License as published by the Free Software Foundation",
           ("under the terms of the GNU Lesser General Public License",)),
    _gnu("lgpl-2.1", "library", "Lesser General Public License", "2.1"),
    _gnu("lgpl-3", "library", "Lesser General Public License", "3"),
    Notice("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
           "General Public License as published by the Free Software Foundation, either version 3 of the License",
           ("under the terms of the GNU Affero General Public License", "either version 3 of the License")),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Licensed under the Apache License Version 2.0",)),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
           "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. "
           "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
           "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
           "specific language governing permissions and limitations under the License.", ("Apache License Version 2.0",)),
    Notice("mit", "Released under the MIT License", ("Released under the MIT License",)),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
           "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
           "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
           "this permission notice shall be included in all copies or substantial portions of the Software.",
           ("to deal in the Software without restriction",)),
    Notice("bsd", _BSD, ("Redistribution and use in source and binary forms",)),
    Notice("bsd-3-clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
           "or promote products derived from this software without specific prior written permission.",
           ("may be used to endorse or promote products derived from this software",)),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
           ("for any purpose with or without fee is hereby granted",)),
    Notice("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
           "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
           "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
           "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
           "software.", ("The origin of this software must not be misrepresented",)),
    Notice("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
           "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
           "execute, and transmit the Software, and to prepare derivative works of the Software",
           ("any person or organization obtaining a copy of the software",)),
    Notice("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
           "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
           "purpose, commercial or non-commercial, and by any means.", ("free and unencumbered software released into the public domain",)),
    Notice("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
           "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
           ("subject to the terms of the Mozilla Public License v 2.0",)),
    Notice("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
           "2.0 which is available at https://www.eclipse.org/legal/epl-2.0", ("under the terms of the Eclipse Public License 2.0",)),
    Notice("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. "
           "This work is published under CC0 1.0 Universal, Public Domain Dedication.",
           ("has waived all copyright and related or neighboring rights",)),
    Notice("cc-by", "Licensed under CC BY 4.0", ("Licensed under CC BY 4.0",)),
    Notice("cc-by-sa", "Licensed under CC BY-SA 4.0", ("Licensed under CC BY SA 4.0",)),
    Notice("cc-by-nc", "Licensed under CC BY-NC 4.0", ("Licensed under CC BY NC 4.0",)),
    Notice("cc-by-nd", "Licensed under CC BY-ND 4.0", ("Licensed under CC BY ND 4.0",)),
    _commons("cc-by", "Attribution"),
    _commons("cc-by-sa", "Attribution-ShareAlike"),
    _commons("cc-by-nc", "Attribution-NonCommercial"),
    _commons("cc-by-nd", "Attribution-NoDerivatives"),
    _commons("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    _commons("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
]
