from gridloom.operators.align import *  # noqa: F401,F403
from gridloom.operators.group import *  # noqa: F401,F403
from gridloom.operators.index import *  # noqa: F401,F403
from gridloom.operators.window import *  # noqa: F401,F403
