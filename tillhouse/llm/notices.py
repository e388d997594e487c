"""Wordings of licence notices, by family: what the licence scanner learns from (fixed values)."""

# Notices the classifier is taught, and templates that confirm it.
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Licensed under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU LGPL, version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ofl": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ],
}
# Other wordings of these families, held out to set how far a probability is to be trusted.
HELD_OUT = {
    "agpl": ["You may use it under the terms of the GNU Affero General Public License, either version 3 or any later version."],
    "apache-2.0": ["This file is licensed to you under the Apache License, Version 2.0."],
    "boost": ["Use, modification and distribution are subject to the Boost Software License, Version 1.0."],
    "bsd": ["This code is released under the BSD 3-Clause License; redistribution and use in source and binary forms are permitted."],
    "cc-by": ["Content is licensed under a Creative Commons Attribution 4.0 License."],
    "cc-by-nc": ["Images are licensed under CC BY-NC 4.0."],
    "cc0": ["The author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
    "epl": ["Made available under the terms of the Eclipse Public License 2.0."],
    "gpl": ["You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "isc": ["Permission to use, copy, modify and distribute this software for any purpose is hereby granted with or without fee."],
    "lgpl": ["You can redistribute this library under the terms of the GNU Lesser General Public License."],
    "mit": ["The code is licensed under the MIT License, see the file LICENSE."],
    "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, version 2.0."],
    "ofl": ["The fonts are licensed under the SIL Open Font License."],
    "proprietary": ["Copyright by the publisher. All rights reserved. Copying is strictly prohibited."],
    "public-domain": ["The code has been released into the public domain."],
    "zlib": ["Provided as-is, without any express or implied warranty; the authors are not liable for damages arising from its use."],
}
# Notices of families that are not taught: none of these may come out as a known one.
UNTAUGHT = [
    "Licensed under the EUPL, Version 1.2 or later.",
    "This program is free software; it comes without any warranty, under the terms of the Do What The Fuck You Want To Public License.",
    "You may redistribute it under the terms of the Artistic License 2.0.",
    "Licensed under the Open Data Commons Open Database License, version 1.0.",
    "PSF is making Python available to Licensee under the terms of the Python Software Foundation License.",
    "Released under the Academic Free License, version 3.0.",
    "SPDX-License-Identifier: CDDL-1.0",
    "SPDX-License-Identifier: EUPL-1.2",
    "Licensed under the Microsoft Reciprocal License.",
]
