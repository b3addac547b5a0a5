from datetime import datetime, timedelta

import pytest

from tessera.operators import versions as V
from tessera.sources.catalog import ITEM_PROFILE, USER_PROFILE, Field, Registry, Table, seeded

T0 = datetime(2024, 1, 1)


def manager(compat=False):
    ticks = iter(T0 + timedelta(minutes=i) for i in range(100))
    return V.Manager(seeded(), lambda: next(ticks), compat)


def test_registry():
    r = seeded()
    assert r.count() == 2 and [t.id for t in r.list()] == ["item_profile", "user_profile"]
    assert USER_PROFILE.has_field("age") and USER_PROFILE.has_field("is_vip")
    assert (USER_PROFILE.field_index("city"), USER_PROFILE.field_index("missing")) == (1, -1)
    assert ITEM_PROFILE.field_names() == ["category", "price", "stock", "rating", "on_sale"]
    assert r.get("x") is None
    with pytest.raises(KeyError):
        r.must_get("x")


@pytest.mark.parametrize(
    "table",
    [
        Table("t", "t", (Field("a", "int"), Field("a", "string"))), Table("t", "t", (Field("a", "int"), Field(" a ", "int"))),
        Table(" ", "t", (Field("a", "int"),)), Table("t", "t", (Field(" ", "int"),)), Table("t", "t", (Field("a", "decimal"),)),
    ],
)
def test_bad_tables(table):
    with pytest.raises(ValueError):
        Registry().register(table)


def test_transitions():
    assert V.can_transition(V.DRAFT, V.PUBLISHED)
    assert not V.can_transition(V.PUBLISHED, V.DRAFT)
    assert not V.can_transition(V.ROLLED_BACK, V.PUBLISHED)


def test_ids_parents_and_layout():
    m = manager()
    a, b, c = m.create("user_profile"), m.create("item_profile"), m.create("user_profile")
    assert (a.id, b.id, c.id) == ("user_profile-v1", "item_profile-v2", "user_profile-v3")
    assert (a.parent_id, b.parent_id, c.parent_id) == ("", "", a.id)
    m.registry.register(Table("user_profile", "u", (Field("age", "int"),)))
    assert a.fields == USER_PROFILE.field_names()
    with pytest.raises(KeyError):
        m.create("nope")


def test_publish_moves_the_pointer_over_tables():
    m = manager()
    a, b = m.create("user_profile"), m.create("item_profile")
    m.publish(a.id)
    assert m.resolve_active() is a
    m.publish(b.id)
    assert m.resolve_active() is b and a.state == V.SUPERSEDED
    with pytest.raises(ValueError):
        m.publish(b.id)


def test_rollback_makes_the_parent_active():
    m = manager()
    a, b = m.create("user_profile"), m.create("user_profile")
    m.publish(a.id)
    m.publish(b.id)
    assert m.rollback(b.id) is a
    assert b.state == V.ROLLED_BACK and a.state == V.PUBLISHED and m.resolve_active() is a
    with pytest.raises(ValueError):
        m.rollback(a.id)


def test_rollback_literally_leaves_none_active():
    m = manager(compat=True)
    a, b = m.create("user_profile"), m.create("user_profile")
    m.publish(a.id)
    m.publish(b.id)
    assert m.rollback(b.id) is a and a.state == V.SUPERSEDED and m.resolve_active() is None


def test_switch_events():
    for compat, n in ((False, 3), (True, 2)):
        m = manager(compat)
        a, b = m.create("user_profile"), m.create("user_profile")
        m.publish(a.id)
        m.publish(b.id)
        events = m.switch_events(T0, T0 + timedelta(hours=1))
        assert len(events) == n and events[-1] == ("", T0 + timedelta(hours=1))
        assert m.switch_events(T0 + timedelta(minutes=4), T0 + timedelta(hours=1)) == [("", T0 + timedelta(hours=1))]
