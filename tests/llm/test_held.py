"""What a worker process keeps from task to task."""

import gc
import weakref

from velado.llm import common


class Table:
    pass


def test_one_thing_is_held_until_another_comes_or_it_is_let_go():
    common.let_go()
    first = common.held(("a",), Table)
    assert common.held(("a",), Table) is first
    gone = weakref.ref(first)
    del first
    common.held(("b",), Table)
    gc.collect()
    assert gone() is None
    gone = weakref.ref(common.held(("b",), Table))
    common.let_go()
    assert gone() is None
    common.let_go()
