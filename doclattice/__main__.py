import sys

from doclattice.plans.merge_docs import main

sys.exit(main())
