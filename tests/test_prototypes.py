import pytest

from quern.errors import NotFound, QueryError
from quern.plans import ops
from quern.plans.ops import Instance, Model


def test_instances_inherit_and_hide():
    area = ops.Op([("r", ops.ref("w") * ops.ref("h"))], ("w", "h"))
    base = Instance({"w": 2, "h": 3, "area": area})
    wide = base.made(w=10)
    assert base.call("area") == 6 and wide.call("area") == 30 and wide.made(h=1).call("area") == 10 and wide.call("area", h=2) == 20 and base.get("w") == 2
    with pytest.raises(NotFound):
        wide.get("depth")
    with pytest.raises(QueryError):
        wide.call("w")


def test_reflected_methods_are_operations():
    class Shop(ops.Library):
        name, version = "shop", "1.0.0"
        rate = 3

        @ops.reflect
        def price(self, n):
            return ops.If(ops.ref("n") > 10, ops.ref("n") * self.rate - 1, ops.ref("n") * self.rate)

    assert Shop().price(4) == 12 and Shop().request("post", "price", n=20) == 59


def test_models_are_rows(spark):
    class User(Model):
        key, values = [("user_id", "u32")], [("first", "string", 100), ("last", "string", 100)]

        def full(self):
            return f"{self.first} {self.last}"

    t = User.table(spark.createDataFrame([(1, "Ann", "Low"), (2, "Bo", "Ek")], "user_id long, first string, last string"))
    t = User(3, "Cy", "Ray").saved(User(1, "Anna", "Low").saved(t))
    assert User.of(t, (1,)).full() == "Anna Low" and User.of(t, (3,)).full() == "Cy Ray" and t.count() == 3
    with pytest.raises(NotFound):
        User.of(t, (9,))
    with pytest.raises(QueryError):
        User(1)
