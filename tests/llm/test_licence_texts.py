"""Licence texts as they are usually found: wrapped, with marks inside sentences and numbered lists."""

from flowloom.llm import licences

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
"""
GPL = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""


def test_licence_texts(make_docs):
    texts = [MIT, GPL, BSD, APACHE, "# SPDX-License-Identifier: MIT\nx = 1", "/* SPDX-License-Identifier: GPL-3.0-or-later */",
             "// SPDX-License-Identifier: Apache-2.0", "Released under the. MIT license", "released under\n\nthe MIT license",
             "Licensed under the Apache License, Version 2.0\n(the \"License\")", "see\nReleased under the MIT License. 1. end"]
    got = {r.doc_id: (r.licences, r.spans) for r in licences.scan_licences(make_docs(list(enumerate(texts)))).collect()}
    assert [got[i][0] for i in range(len(texts))] == [
        "MIT", "GPL-3.0", "BSD", "Apache-2.0", "MIT", "GPL-3.0", "Apache-2.0", "", "", "Apache-2.0", "MIT"]
    assert got[10][1] == "MIT@1+1" and got[4][1] == "MIT@0+2"
