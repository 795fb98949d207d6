"""python -m tallyweave train | infer | validate"""

import sys

from tallyweave.plans.commands import main

sys.exit(main(sys.argv[1:]))
