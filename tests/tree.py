"""A small landed tree whose rows hit the edge cases of the models."""

import json
from pathlib import Path

DAY1, DAY2 = "2025-09-01", "2025-09-02"

POSITIONS = [
    {"id": 1, "singular_name": "Goalkeeper", "singular_name_short": "GKP", "squad_min_play": 1, "squad_max_play": 1, "element_count": 80},
    {"id": 2, "singular_name": "Defender", "singular_name_short": "DEF", "squad_min_play": 3, "squad_max_play": 5, "element_count": 200},
    {"id": 3, "singular_name": "Midfielder", "singular_name_short": "MID", "squad_min_play": 2, "squad_max_play": 5, "element_count": 300},
    {"id": 4, "singular_name": "Forward", "singular_name_short": "FWD", "squad_min_play": 1, "squad_max_play": 3, "element_count": 90},
]
TEAMS = [(1, "Ashford", "ARS", 3), (2, "Brightwell", "BHA", 36), (3, "Chelmer", "CHE", 8), (4, "Derwent", "DER", 24)]


def team(row):
    key, name, short, code = row
    return {"id": key, "name": name, "short_name": short, "code": code, "strength": 3 + key % 3, "played": 0,
            "win": 0, "draw": 0, "loss": 0, "points": 0, "position": 0, "form": None, "unavailable": False,
            "strength_overall_home": 1100, "strength_overall_away": 1110, "strength_attack_home": 1120,
            "strength_attack_away": 1130, "strength_defence_home": 1140, "strength_defence_away": 1150}


def player(key, first, second, web, position, team_id, **more):
    base = {
        "id": key, "first_name": first, "second_name": second, "web_name": web, "code": 1000 + key,
        "team": team_id, "element_type": position, "now_cost": 50 + key, "cost_change_event": 0,
        "cost_change_start": 1, "selected_by_percent": f"{key}.5", "transfers_in_event": 100 * key,
        "transfers_out_event": 50, "transfers_in": 5000000000, "transfers_out": 4, "form": f"{key % 5}.0",
        "points_per_game": "3.1", "total_points": 10 * key, "event_points": 2, "ep_next": "2.5", "ep_this": "2.0",
        "value_form": "0.5", "value_season": "5.0", "minutes": 900, "starts": 10, "goals_scored": key % 4,
        "assists": 1, "clean_sheets": key % 3, "goals_conceded": 8, "saves": 0, "bonus": 3, "bps": 100,
        "influence": "10.1", "creativity": "9.9", "threat": "8.8", "ict_index": "28.8", "expected_goals": "1.25",
        "expected_assists": "0.75", "expected_goal_involvements": "2.00", "expected_goals_conceded": "9.1",
        "yellow_cards": 1, "red_cards": 0, "status": "a", "chance_of_playing_next_round": None,
        "chance_of_playing_this_round": None, "news": "", "news_added": None, "can_transact": True,
        "can_select": True, "removed": False,
    }
    return {**base, **more}


def squad(day):
    late = day == DAY2
    rows = [
        player(1, "Corin", "Vale Tessier", "Vale", 1, 1),
        player(2, "Ilmar", "Tünçağ", "Tünçağ", 3, 1, form=None, now_cost=62 + late, status="d",
               chance_of_playing_next_round=50, news="Knock", news_added="2025-08-30T10:00:07.250000Z"),
        player(3, "Đurađ", "Vesković", "Vesković", 1, 2, status="i", chance_of_playing_next_round=75),
        player(4, "Mads", "Østvang", "Østvang", 3, 1, status="i", chance_of_playing_next_round=0),
        player(5, "Sarp", "Yalıoğan", "S.Yalıoğan", 2, 2, status="d"),
        player(6, "Lorne", "O'Carrick", "O'Carrick", 2, 3, removed=None),
        player(7, "Telmo Aires", "Corvo Mendral", "T.Mendral", 3, 3, status="n"),
        player(8, "Odrian", "Tavares Lumen", "Odrian", 2, 4, now_cost=0),
        player(9, "Wes", "Garrow", "Garrow", 2, 1, status="u"),
        player(10, "Tom", "Smith Jones", "T.Smith", 4, 2, removed=True),
        player(11, "Tom", "Smith Brown", "Smith", 4, 4),
        player(12, "Tom", "Smith Green", "Smith", 4, 4),
    ]
    if late:
        rows.append(player(13, "New", "Signing", "Signing", 3, 4, now_cost="bad"))
        rows[8]["now_cost"] -= 3
        rows[0]["selected_by_percent"] = "9.25"
    return rows


def bootstrap(day):
    events = [
        {"id": 1, "deadline_time": "2025-08-15T17:30:00Z", "is_current": False, "is_next": False, "finished": True,
         "average_entry_score": 50, "highest_score": 120},
        {"id": 2, "deadline_time": "2025-08-22T17:30:00Z", "is_current": day == DAY1, "is_next": False,
         "finished": True, "average_entry_score": 55, "highest_score": 130},
        {"id": 3, "deadline_time": "2025-09-13T10:00:00Z", "is_current": False, "is_next": day == DAY2,
         "finished": False, "average_entry_score": 0, "highest_score": None},
    ]
    return {"elements": squad(day), "teams": [team(t) for t in TEAMS], "element_types": POSITIONS, "events": events}


def fixture(key, home, away, kickoff, score=None, difficulty=(2, 4)):
    return {"id": key, "code": 9000000000 + key, "event": 1, "team_h": home, "team_a": away,
            "team_h_score": score[0] if score else None, "team_a_score": score[1] if score else None,
            "team_h_difficulty": difficulty[0], "team_a_difficulty": difficulty[1], "kickoff_time": kickoff,
            "started": bool(score), "finished": bool(score), "minutes": 90 if score else 0}


def fixture_list():
    return [
        fixture(1, 1, 2, "2025-08-16T14:00:00Z", (2, 0)),
        fixture(2, 3, 1, "2025-08-23T14:00:00Z", (1, 1)),
        fixture(3, 2, 3, "2025-08-23T14:00:00Z", (0, 3)),
        fixture(4, 1, 3, None, difficulty=(5, 5)),
        fixture(5, 1, 2, "2025-09-13T14:00:00Z", difficulty=(2, 4)),
        fixture(6, 2, 1, "2025-09-13T14:00:00Z", difficulty=(3, 3)),
        fixture(7, 1, 3, "2025-09-20T14:00:00Z", difficulty=(3, 2)),
        fixture(8, 3, 1, "2025-09-27T14:00:00Z", difficulty=(1, 5)),
        fixture(9, 1, 2, "2025-10-04T14:00:00Z", difficulty=(4, 1)),
        fixture(10, 2, 1, "2025-10-11T14:00:00Z", difficulty=(2, 2)),
    ]


def match(day, score, home, away, names, events):
    return {"startDate": f"{day}T00:00:00", "home": {"teamId": home, "name": f"Team {home}"},
            "away": {"teamId": away, "name": f"Team {away}"}, "ftScore": score, "attendance": 41000,
            "venueName": "Ground", "events": events, "playerIdNameDictionary": names}


def event(key, kind, outcome="Successful", **more):
    return {"id": key, "minute": 10, "second": 4.0, "teamId": 11, "playerId": 101, "type": {"displayName": kind},
            "outcomeType": {"displayName": outcome} if outcome else None, "isTouch": True, "x": 50.5, "y": 20,
            "qualifiers": [{"type": {"value": 140, "displayName": "PassEndX"}, "value": "80.1"}], **more}


MATCHES = {
    501: match("2025-05-18", "2 : 0", 11, 12,
               {"101": "Corin Vale", "102": "Ilmar Tuncag", "103": "Djuradj Veskovic", "106": "Tom Smith"},
               [event(1, "Goal"), event(2, "Goal"), event(2, "Pass", "Unsuccessful"), event(3, "Start", None, playerId=None)]),
    502: match("2025-08-16", "1 : 1", 12, 11,
               {"101": "Corin Vale", "102": "İlmar Tünçağ", "104": "Telmo Mendral", "105": "Odrian"},
               [event(4, "Goal"), event(5, "Goal")]),
    503: match("2025-07-01", "0 : 0", 11, 13,
               {"101": "C. Vale", "102": "Ilmar Tuncag", "106": "Tom Smith"}, [event(6, "Pass")]),
}


def season_player(key, name, minutes="900", xg="3.5", goals="4", **more):
    base = {"id": str(key), "player_name": name, "team_title": "Ashford,Chelmer", "position": "F M S", "games": "10",
            "time": minutes, "goals": goals, "npg": "3", "assists": "2", "shots": "20", "key_passes": "11", "xG": xg,
            "npxG": "2.5", "xA": "1.5", "xGChain": "4.4", "xGBuildup": "1.1", "yellow_cards": "1", "red_cards": "0"}
    return {**base, **more}


SEASON_PLAYERS = [
    season_player(201, "Corin Vale"), season_player(202, "Ilmar Tuncag", xg="4.25"),
    season_player(203, "Djuradj Veskovic"), season_player(204, "Telmo Mendral", minutes="1800", npxG="6.5"),
    season_player(205, "Lorne O&#039;Carrick"), season_player(206, "Mads Østvang", minutes="449"),
    season_player(207, "Wes Garrow", xg="0.5", goals="0"), season_player(208, "Yaliogan Sarp", xA="0.1"),
]
LEAGUE = {
    "players": SEASON_PLAYERS,
    "dates": [
        {"id": "301", "datetime": "2025-08-16 14:00:00", "isResult": True, "h": {"id": "83", "title": "Ashford"},
         "a": {"id": "87", "title": "Chelmer"}, "goals": {"h": "1", "a": "1"}, "xG": {"h": "1.5", "a": "0.9"}},
        {"id": "302", "datetime": "2026-02-01 14:00:00", "isResult": False, "h": {"id": "87", "title": "Chelmer"},
         "a": {"id": "83", "title": "Ashford"}, "goals": {"h": None, "a": None}, "xG": {"h": None, "a": None}},
    ],
    "teams": {
        "83": {"id": "83", "title": "Ashford", "history": [
            {"date": "2025-08-16 14:00:00", "h_a": "h", "scored": 1, "missed": 1, "result": "d", "pts": 1, "xG": 1.5,
             "xGA": 0.9, "npxG": 1.5, "npxGA": 0.9, "npxGD": 0.6, "xpts": 1.8, "ppda": {"att": 200, "def": 25},
             "ppda_allowed": {"att": 90, "def": 0}, "deep": 7, "deep_allowed": 3}]},
        "87": {"id": "87", "title": "Chelmer", "history": [
            {"date": "2025-08-16 14:00:00", "h_a": "a", "scored": 1, "missed": 1, "result": "d", "pts": 1, "xG": 0.9,
             "xGA": 1.5, "npxG": 0.9, "npxGA": 1.5, "npxGD": -0.6, "xpts": 0.9, "ppda": {"att": 90, "def": 10},
             "ppda_allowed": {"att": 200, "def": 25}, "deep": 3, "deep_allowed": 7}]},
    },
}


def dump(path: Path, payload) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload), encoding="utf-8")


def write(root: Path) -> None:
    for day in (DAY1, DAY2):
        base = root / "game" / "season=2025" / f"load_date={day}"
        dump(base / "bootstrap_static.json", bootstrap(day))
        dump(base / "fixtures.json", fixture_list())
    for key, payload in MATCHES.items():
        dump(root / f"matchcentre/events/season=2025/load_date={DAY1}/{key}.json", payload)
    dump(root / f"matchcentre/matches/season=2025/load_date={DAY1}/page.json", {"any": {"2025": [1, 2]}})
    for day, players in ((DAY1, SEASON_PLAYERS[:2]), (DAY2, SEASON_PLAYERS)):
        base = root / "seasonstats" / "season=2025" / f"load_date={day}"
        dump(base / "players.json", players)
        dump(base / "matches.json", LEAGUE["dates"])
        dump(base / "teams.json", list(LEAGUE["teams"].values()))
    (root / "player_map_overrides.csv").write_text(
        "player_ud_id,player_code,note\n203,1003,transliteration\n208,1005,name order\n299,9999,left the league\n"
        "205,1009,clashes with a ladder pair\n",
        encoding="utf-8",
    )
