import sys

from regionlink.plans.cli import main


def run() -> None:
    sys.exit(main())


if __name__ == "__main__":
    run()
