import sys

from varloom.plans.cli import main

if __name__ == "__main__":
    sys.exit(main())
