"""The command-line reports run end to end on the smallest test tables."""

from paths import SF_SMALL

from pumpwatch import cli


def test_reports(spark, capsys):
    for cmd in ("summary", "latest", "regions", "snapshots", "variations", "schema"):
        assert cli.main(["--sf-dir", SF_SMALL, cmd]) == 0
    out = capsys.readouterr().out
    assert "observations=" in out and "period: " in out
    assert out.count("¢") > 20
    assert "# price | fuel | station | city" in out and "# poll | observations | changes" in out
    assert "prices (" in out and "stations (" in out


def test_variation_lists_ordered(spark, capsys):
    assert cli.main(["--sf-dir", SF_SMALL, "variations"]) == 0
    up, down = capsys.readouterr().out.split("up:\n")[1].split("down:\n")

    def moves(text):
        return [float(line.split("¢")[0]) for line in text.strip().splitlines() if not line.startswith("#")]
    up, down = moves(up), moves(down)
    assert 0 < len(up) <= 10 and 0 < len(down) <= 10
    assert all(d > 0 for d in up) and up == sorted(up, reverse=True)
    assert all(d < 0 for d in down) and down == sorted(down)
