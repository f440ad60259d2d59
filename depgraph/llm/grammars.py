"""EBNF grammars of the supported languages, in the notation of :mod:`depgraph.llm.gll`.

They describe syntax only (no name or type checks). Binary operators are written flat, because precedence
doesn't change which texts are valid. Marks: ``m`` name of a possible function, ``b`` start of its body,
``d`` name of a certain function. Rules starting with ``Frag`` are the islands from which parsing goes on
behind an error: declarations and members may stand anywhere there, so may stray closing words.
"""

PYTHON = r"""
File = { Stmt | NEWLINE } EOF ;
Frag = { Stmt | NEWLINE } EOF ;
Stmt = Simple | Compound ;
Simple = Small { ';' Small } [ ';' ] NEWLINE ;
Small = ExprStmt | 'pass' | 'break' | 'continue' | 'return' [ StarExprs ] | 'raise' [ Expr [ 'from' Expr ] ]
  | ( 'global' | 'nonlocal' ) NAME { ',' NAME } | 'del' TargetList | 'assert' Expr [ ',' Expr ]
  | 'type' NAME [ TypeParams ] '=' Expr
  | 'import' Dotted [ 'as' NAME ] { ',' Dotted [ 'as' NAME ] }
  | 'from' ( { '.' | '...' } Dotted | ( '.' | '...' ) { '.' | '...' } ) 'import' ( '*' | Imported | '(' Imported [ ',' ] ')' ) ;
Dotted = NAME { '.' NAME } ;
Imported = NAME [ 'as' NAME ] { ',' NAME [ 'as' NAME ] } ;
ExprStmt = { TargetList '=' } ( Yield | StarExprs ) | Target ':' Expr [ '=' ( Yield | StarExprs ) ] | Target AUG ( Yield | StarExprs ) ;
StarExprs = StarExpr { ',' StarExpr } [ ',' ] ;
StarExpr = '*' Flat | Expr ;
Yield = 'yield' [ 'from' Expr | StarExprs ] ;
TargetList = StarTarget { ',' StarTarget } [ ',' ] ;
StarTarget = [ '*' ] Target ;
Target = NAME | '(' [ TargetList ] ')' | '[' [ TargetList ] ']' | Atom { Trailer } ( '.' NAME | '[' Slices ']' ) ;
Expr = 'lambda' [ LambdaParams ] ':' Expr | Or [ 'if' Or 'else' Expr ] ;
NamedExpr = [ NAME ':=' ] Expr ;
Or = Not { ( 'and' | 'or' ) Not } ;
Not = { 'not' } Flat ;
Flat = Unary { ( BINOP | '*' | '**' | '-' | '+' | '|' | 'in' | 'is' [ 'not' ] | 'not' 'in' ) Unary } ;
Unary = { '+' | '-' | '~' } [ 'await' ] Atom { Trailer } ;
Trailer = '.' NAME | '(' [ Args ] ')' | '[' Slices ']' ;
Args = Arg { ',' Arg } [ ',' ] ;
Arg = ( '*' | '**' ) Expr | NAME '=' Expr | NamedExpr [ CompFor ] ;
Atom = NAME | NUM | STR { STR } | 'None' | 'True' | 'False' | '...' | '(' [ Yield | StarNamed ( CompFor | { ',' StarNamed } [ ',' ] ) ] ')'
  | '[' [ StarNamed ( CompFor | { ',' StarNamed } [ ',' ] ) ] ']' | '{' [ Item ( CompFor | { ',' Item } [ ',' ] ) | StarNamed ( CompFor | { ',' StarNamed } [ ',' ] ) ] '}' ;
StarNamed = '*' Flat | NamedExpr ;
Item = '**' Flat | Expr ':' Expr ;
CompFor = [ 'async' ] 'for' TargetList 'in' Or { 'if' CompIf | [ 'async' ] 'for' TargetList 'in' Or } ;
CompIf = [ NAME ':=' ] Or | 'lambda' [ LambdaParams ] ':' Or ;
Slices = Slice { ',' Slice } [ ',' ] ;
Slice = [ Expr ] ':' [ Expr ] [ ':' [ Expr ] ] | NamedExpr | '*' Flat ;
LambdaParams = LambdaParam { ',' LambdaParam } [ ',' ] ;
LambdaParam = NAME [ '=' Expr ] | '*' [ NAME ] | '**' NAME | '/' ;
Params = Param { ',' Param } [ ',' ] ;
Param = NAME [ ':' Expr ] [ '=' Expr ] | '*' [ NAME [ ':' StarExpr ] ] | '**' NAME [ ':' Expr ] | '/' ;
TypeParams = '[' TypeParam { ',' TypeParam } [ ',' ] ']' ;
TypeParam = ( NAME [ ':' Expr ] | '*' NAME | '**' NAME ) [ '=' StarExpr ] ;
Suite = Simple | NEWLINE INDENT Stmt { Stmt } DEDENT ;
Compound = 'if' NamedExpr ':' Suite { 'elif' NamedExpr ':' Suite } [ 'else' ':' Suite ] | 'while' NamedExpr ':' Suite [ 'else' ':' Suite ]
  | [ 'async' ] 'for' TargetList 'in' StarExprs ':' Suite [ 'else' ':' Suite ]
  | 'try' ':' Suite ( 'finally' ':' Suite | Except { Except } [ 'else' ':' Suite ] [ 'finally' ':' Suite ] )
  | [ 'async' ] 'with' ( WithItem { ',' WithItem } | '(' WithItem { ',' WithItem } [ ',' ] ')' ) ':' Suite
  | { '@' NamedExpr NEWLINE } ( [ 'async' ] 'def' NAME@d [ TypeParams ] '(' [ Params ] ')' [ '->' StarExprs ] ':' Suite | 'class' NAME@c [ TypeParams ] [ '(' [ Args ] ')' ] ':' Suite )
  | 'match' StarExprs ':' NEWLINE INDENT Case { Case } DEDENT ;
Except = 'except' [ '*' ] [ StarExprs [ 'as' NAME ] ] ':' Suite ;
WithItem = Expr [ 'as' StarTarget ] ;
Case = 'case' Pats [ 'if' NamedExpr ] ':' Suite ;
Pats = PatStar { ',' PatStar } [ ',' ] ;
PatStar = '*' NAME | Pat ;
Pat = PatAtom { '|' PatAtom } [ 'as' NAME ] ;
PatAtom = [ '-' ] NUM [ ( '+' | '-' ) NUM ] | STR { STR } | 'None' | 'True' | 'False' | NAME { '.' NAME } [ '(' [ PatArg { ',' PatArg } [ ',' ] ] ')' ]
  | '(' [ Pats ] ')' | '[' [ Pats ] ']' | '{' [ PatItem { ',' PatItem } [ ',' ] ] '}' ;
PatArg = [ NAME '=' ] Pat ;
PatItem = '**' NAME | ( [ '-' ] NUM | STR { STR } | 'None' | 'True' | 'False' | NAME { '.' NAME } ) ':' Pat ;
"""

C = r"""
File = { External } EOF ;
Frag = { External | Stmt } EOF ;
External = Specs FuncDecl FuncBody | Declaration | ';' | Asm ';' | MACRO [ '(' [ Args ] ')' ] [ ';' ] | StaticAssert ;
StaticAssert = ( '_Static_assert' | 'static_assert' ) '(' Cond [ ',' STR ] ')' ';' ;
Asm = ASM { 'volatile' | 'goto' | 'inline' } '(' { STR | ':' | ',' | '(' Expr ')' | '[' NAME ']' | NAME } ')' ;
Declaration = Specs [ InitDecl { ',' InitDecl } ] ';' ;
InitDecl = Decl [ '=' Init ] ;
Specs = { Qual } ( BASIC { BASIC | Qual } | TypeName { Qual } | ( 'struct' | 'union' ) { Attr } ( NAME [ Fields ] | Fields ) { Qual } | 'enum' { Attr } ( NAME [ ':' Type ] [ Enums ] | Enums ) { Qual } | TYPEOF '(' ( Expr | Type ) ')' { Qual } | 'auto' { Qual } ) ;
TypeName = NAME | '_Atomic' '(' Type ')' ;
Qual = QUAL | Attr | MACRO [ '(' [ Args ] ')' ] | ( '_Alignas' | 'alignas' ) '(' ( Cond | Type ) ')' ;
Attr = '__attribute__' '(' '(' [ AttrItem { ',' AttrItem } ] ')' ')' | '[' '[' [ AttrItem { ',' AttrItem } ] ']' ']' ;
AttrItem = [ WORD [ '::' WORD ] [ '(' [ Args ] ')' ] ] ;
Fields = '{' { Specs [ FieldDecl { ',' FieldDecl } ] ';' | ';' | StaticAssert } '}' { Attr } ;
FieldDecl = [ Decl ] ':' Cond | Decl ;
Enums = '{' Enum { ',' Enum } [ ',' ] '}' ;
Enum = NAME { Attr } [ '=' Cond ] ;
Decl = { '*' { Qual } } ( NAME@m | '(' { Attr } Decl ')' ) { '[' { QUAL } [ Cond | '*' ] ']' | '(' [ ParamList ] ')' } { Attr | Asm } ;
FuncDecl = { '*' { Qual } } ( NAME@m { '[' { QUAL } [ Cond | '*' ] ']' } '(' [ ParamList ] ')' | '(' { Attr } Decl ')' ) { '[' { QUAL } [ Cond | '*' ] ']' | '(' [ ParamList ] ')' } { Attr | Asm } ;
Abstract = '*' { Qual } [ Abstract ] | '(' [ Abstract ] ')' { AbsSuffix } | AbsSuffix { AbsSuffix } ;
AbsSuffix = '[' { QUAL } [ Cond | '*' ] ']' | '(' [ ParamList ] ')' ;
Type = Specs [ Abstract ] ;
ParamList = Param { ',' Param } [ ',' '...' ] | '...' ;
Param = Specs [ Decl | Abstract ] ;
Init = Cond | '{' [ InitItem { ',' InitItem } [ ',' ] ] '}' ;
InitItem = [ ( '.' NAME | '[' Cond [ '...' Cond ] ']' ) { '.' NAME | '[' Cond ']' } '=' ] Init ;
Block = '{' { Stmt | Declaration | StaticAssert } '}' ;
FuncBody = '{'@b { Stmt | Declaration | StaticAssert } '}' ;
Stmt = Block | 'if' '(' Expr ')' Stmt [ 'else' Stmt ] | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
  | 'for' '(' ( Declaration | [ Expr ] ';' ) [ Expr ] ';' [ Expr ] ')' Stmt | 'switch' '(' Expr ')' Stmt
  | 'return' [ Expr | '{' '}' ] ';' | 'break' ';' | 'continue' ';' | 'goto' ( NAME | '*' Expr ) ';'
  | ( NAME { Attr } | 'case' Cond [ '...' Cond ] | 'default' ) ':' ( Stmt | Declaration | LabelEnd ) | [ Expr ] ';' | Asm ';' | MACRO '(' [ Args ] ')' | MACRO | Attr ';' ;
LabelEnd = ;
Expr = Cond { ',' Cond } ;
Cond = Unary { ( BINOP | ASSIGN | '*' | '=' ) Unary | '?' [ Expr ] ':' Unary } ;
Unary = { PREFIX | '*' } ( Postfix | ( 'sizeof' | ALIGNOF ) ( Unary | '(' Type ')' ) | '(' Type ')' ( Unary | '{' [ InitItem { ',' InitItem } [ ',' ] ] '}' { Suffix } ) ) ;
Postfix = Primary { Suffix } ;
Suffix = '[' Expr ']' | '(' [ Args ] ')' | ( '.' | '->' ) NAME | INCDEC ;
Args = Arg { ',' Arg } ;
Arg = Cond | Type | BASIC ;
Primary = NAME | NUM | CHAR | STR { STR | MACRO } | MACRO STR { STR | MACRO } | '(' Expr ')' | '(' Block ')' | '_Generic' '(' Cond { ',' ( Type | 'default' ) ':' Cond } ')' ;
"""

JAVA = r"""
File = [ { Annotation } 'package' Qualified ';' ] { Import | ';' } { TypeDecl | Member | ';' } EOF | { Annotation } [ 'open' ] 'module' Qualified '{' { WORD { WORD | '.' | ',' } ';' } '}' EOF ;
Frag = { Import | 'package' Qualified ';' | TypeDecl | Member | Stmt } EOF ;
Import = 'import' [ 'static' ] Qualified [ '.' '*' ] ';' | 'import' 'module' Qualified ';' ;
Qualified = NAME { '.' NAME } ;
Annotation = '@' Qualified [ '(' [ AnnValue { ',' AnnValue } [ ',' ] ] ')' ] ;
AnnValue = [ NAME '=' ] ( Cond | Annotation | '{' [ AnnValue { ',' AnnValue } ] [ ',' ] '}' ) ;
Mods = { Annotation | MODIFIER | 'static' | 'default' | 'final' | 'synchronized' | 'abstract' | 'non' '-' 'sealed' } ;
TypeDecl = Mods ( ClassDecl | InterfaceDecl | EnumDecl | RecordDecl | '@' 'interface' NAME '{' { AnnMember } '}' ) ;
ClassDecl = 'class' NAME@c [ TypeParams ] [ 'extends' Type ] [ 'implements' Types ] [ 'permits' Types ] ClassBody ;
InterfaceDecl = 'interface' NAME@c [ TypeParams ] [ 'extends' Types ] [ 'permits' Types ] ClassBody ;
EnumDecl = 'enum' NAME@c [ 'implements' Types ] '{' [ EnumConst { ',' EnumConst } ] [ ',' ] [ ';' { Member | ';' } ] '}' ;
EnumConst = { Annotation } NAME [ '(' [ Args ] ')' ] [ ClassBody ] ;
RecordDecl = 'record' NAME@c [ TypeParams ] '(' [ Params ] ')' [ 'implements' Types ] '{' { Member | Mods NAME Block | ';' } '}' ;
AnnMember = Mods Type NAME '(' ')' [ 'default' AnnValue ] ';' | Mods Type Var { ',' Var } ';' | TypeDecl | ';' ;
ClassBody = '{' { Member | ';' } '}' ;
Member = TypeDecl | [ 'static' ] Block | Mods [ TypeParams ] ( Type | 'void' ) NAME@m '(' [ Params ] ')' { '[' ']' } [ 'throws' Types ] ( Body | ';' )
  | Mods [ TypeParams ] NAME@m '(' [ Params ] ')' [ 'throws' Types ] Body | Mods Type Var { ',' Var } ';' ;
Body = '{'@b { Stmt } '}' ;
Params = Param { ',' Param } ;
Param = { Annotation | 'final' } Type [ { Annotation } '...' ] ( NAME [ { '[' ']' } ] | [ NAME '.' ] 'this' ) ;
TypeParams = '<' TypeParam { ',' TypeParam } '>' ;
TypeParam = { Annotation } NAME [ 'extends' Type { '&' Type } ] ;
Types = Type { ',' Type } ;
Type = { Annotation } ( PRIMITIVE | NAME [ TypeArgs ] { '.' { Annotation } NAME [ TypeArgs ] } ) { { Annotation } '[' ']' } ;
TypeArgs = '<' [ TypeArg { ',' TypeArg } ] '>' ;
TypeArg = Type | { Annotation } '?' [ ( 'extends' | 'super' ) Type ] ;
Var = NAME { '[' ']' } [ '=' Init ] ;
Init = Assign | '{' [ Init { ',' Init } ] [ ',' ] '}' ;
Block = '{' { Stmt } '}' ;
Local = { Annotation | 'final' } Type Var { ',' Var } ;
Stmt = Block | Local ';' | TypeDecl | ';' | StmtExpr ';' | NAME ':' Stmt | 'if' '(' Assign ')' Stmt [ 'else' Stmt ] | 'while' '(' Assign ')' Stmt | 'do' Stmt 'while' '(' Assign ')' ';'
  | 'for' '(' ( [ Local | StmtExpr { ',' StmtExpr } ] ';' [ Assign ] ';' [ StmtExpr { ',' StmtExpr } ] | { Annotation | 'final' } Type NAME ':' Assign ) ')' Stmt
  | 'assert' Assign [ ':' Assign ] ';' | Switch | 'break' [ NAME ] ';' | 'continue' [ NAME ] ';' | 'return' [ Assign ] ';' | 'throw' Assign ';' | 'yield' Assign ';'
  | 'synchronized' '(' Assign ')' Block | 'try' Block ( Catch { Catch } [ 'finally' Block ] | 'finally' Block )
  | 'try' '(' Resource { ';' Resource } [ ';' ] ')' Block { Catch } [ 'finally' Block ] ;
Catch = 'catch' '(' { Annotation | 'final' } Type { '|' Type } NAME ')' Block ;
Resource = Local | Assign ;
Switch = 'switch' '(' Assign ')' '{' { Label ':' { Stmt } | Label '->' ( Assign ';' | Block | 'throw' Assign ';' ) } '}' ;
Label = 'case' CaseItem { ',' CaseItem } [ 'when' Assign ] | 'default' ;
CaseItem = Assign | Pattern | 'default' ;
Pattern = { Annotation | 'final' } Type ( NAME | '(' [ Pattern { ',' Pattern } ] ')' [ NAME ] ) ;
StmtExpr = INCDEC Unary | Chain ( ASSIGN | '=' ) Assign | Chain INCDEC | Primary { Select } CallEnd | CreateNew { Select } [ CallEnd ] | NAME '(' [ Args ] ')' | ( 'this' | 'super' ) '(' [ Args ] ')' ;
CallEnd = '.' [ TypeArgs ] NAME '(' [ Args ] ')' | '.' ( 'super' | 'this' ) '(' [ Args ] ')' | '.' 'new' Type '(' [ Args ] ')' [ ClassBody ] ;
Chain = Primary { Select } ;
Assign = Lambda | Cond [ ( ASSIGN | '=' ) Assign ] ;
Lambda = ( NAME | '(' [ Params | NAME { ',' NAME } ] ')' ) '->' ( Assign | Block ) ;
Cond = Flat [ '?' Assign ':' ( Lambda | Cond ) ] ;
Flat = Unary { BinOp Unary | 'instanceof' ( Type | Pattern ) } ;
BinOp = BINOP | '<' | '>' [ '>' [ '>' ] ] | '-' | '&' | '|' ;
Unary = { PREFIX | '-' | INCDEC } ( Chain { INCDEC } | '(' Type { '&' Type } ')' ( Unary | Lambda ) | Switch ) ;
Primary = NAME | NUM | CHAR | STR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' Assign ')' | CreateNew | ( PRIMITIVE | 'void' ) { '[' ']' } ( '.' 'class' | '::' 'new' )
  | NAME '(' [ Args ] ')' | NAME { '.' NAME } '[' ']' { '[' ']' } ( '.' 'class' | '::' 'new' ) | Type '::' ( [ TypeArgs ] NAME | 'new' ) ;
CreateNew = 'new' [ TypeArgs ] { Annotation } ( PRIMITIVE | NAME [ TypeArgs ] { '.' NAME [ TypeArgs ] } ) ( '(' [ Args ] ')' [ ClassBody ] | '[' Assign ']' { '[' [ Assign ] ']' } | '[' ']' { '[' ']' } '{' [ Init { ',' Init } ] [ ',' ] '}' ) ;
Select = '.' [ TypeArgs ] NAME [ '(' [ Args ] ')' ] | '.' ( 'this' | 'class' | 'super' ) [ '(' [ Args ] ')' ] | '.' 'new' Type '(' [ Args ] ')' [ ClassBody ] | '[' Assign ']' | '::' [ TypeArgs ] ( NAME | 'new' ) ;
Args = Assign { ',' Assign } ;
"""

GO = r"""
File = 'package' NAME Semi { 'import' ( ImportSpec | '(' { ImportSpec Semi } [ ImportSpec ] ')' ) Semi } { TopDecl Semi } EOF ;
Frag = { TopDecl Semi | Stmt Semi | Semi | 'package' NAME Semi | 'import' ( ImportSpec | '(' { ImportSpec Semi } [ ImportSpec ] ')' ) Semi } EOF ;
Semi = ';' ;
ImportSpec = [ NAME | '.' ] STR ;
TopDecl = Decl | 'func' [ '(' [ Params ] ')' ] NAME@d [ TypeParams ] Signature [ FuncBody ] ;
FuncBody = '{'@b Stmts '}' ;
Decl = 'const' ( ConstSpec | '(' { ConstSpec Semi } [ ConstSpec ] ')' ) | 'var' ( VarSpec | '(' { VarSpec Semi } [ VarSpec ] ')' ) | 'type' ( TypeSpec | '(' { TypeSpec Semi } [ TypeSpec ] ')' ) ;
ConstSpec = Names [ [ Type ] '=' Exprs ] ;
VarSpec = Names ( Type [ '=' Exprs ] | '=' Exprs ) ;
TypeSpec = NAME@c [ TypeParams ] [ '=' ] Type ;
Names = NAME { ',' NAME } ;
TypeParams = '[' TypeParam { ',' TypeParam } [ ',' ] ']' ;
TypeParam = Names Constraint ;
Constraint = [ '~' ] Type { '|' [ '~' ] Type } ;
Signature = '(' [ Params ] ')' [ '(' [ Params ] ')' | Type ] ;
Params = Param { ',' Param } [ ',' ] ;
Param = [ NAME ] [ '...' ] Type ;
Type = NAME [ '.' NAME ] [ '[' Type { ',' Type } [ ',' ] ']' ] | '*' Type | '(' Type ')' | '[' [ Expr | '...' ] ']' Type | 'map' '[' Type ']' Type
  | 'chan' [ '<-' ] Type | '<-' 'chan' Type | 'func' Signature | 'struct' '{' { Field Semi } [ Field ] '}' | 'interface' '{' { IfaceElem Semi } [ IfaceElem ] '}' ;
Field = ( Names Type | [ '*' ] NAME [ '.' NAME ] [ '[' Type { ',' Type } ']' ] ) [ STR ] ;
IfaceElem = NAME Signature | Constraint ;
Block = '{' Stmts '}' ;
Stmts = { [ Stmt ] Semi } [ Stmt ] ;
Stmt = Decl | NAME ':' [ Stmt ] | Simple | 'go' Expr | 'defer' Expr | 'return' [ Exprs ] | 'break' [ NAME ] | 'continue' [ NAME ] | 'goto' NAME | 'fallthrough' | Block | If
  | 'switch' ( [ [ SimpleN ] ';' ] [ ExprN ] | [ [ SimpleN ] ';' ] [ NAME ':=' ] PrimaryN '.' '(' 'type' ')' ) '{' { ( 'case' Cases | 'default' ) ':' Stmts } '}'
  | 'select' '{' { ( 'case' Simple | 'default' ) ':' Stmts } '}' | 'for' [ ExprN | [ SimpleN ] ';' [ ExprN ] ';' [ SimpleN ] | [ ExprsN ( '=' | ':=' ) ] 'range' ExprN ] Block ;
If = 'if' [ [ SimpleN ] ';' ] ExprN Block [ 'else' ( If | Block ) ] ;
Cases = CaseItem { ',' CaseItem } ;
CaseItem = Expr | Type ;
Simple = Expr [ INCDEC | '<-' Expr ] | Exprs ( ASSIGN | '=' | ':=' ) Exprs ;
Exprs = Expr { ',' Expr } ;
Expr = Unary { ( BINOP | '*' | '<-' | '|' | '-' | '+' ) Unary } ;
Unary = { PREFIX | '*' | '<-' | '-' | '+' | '~' } Primary ;
Primary = Operand { Suffix } ;
Suffix = '.' ( NAME | '(' Type ')' | '(' 'type' ')' ) | '[' ( Expr | [ Expr ] ':' [ Expr ] [ ':' Expr ] | Type { ',' Type } [ ',' ] ) ']' | '(' [ Arg { ',' Arg } [ '...' ] [ ',' ] ] ')' ;
Arg = Expr | Type ;
Operand = Lit | NAME | '(' ( Expr | Type ) ')' | 'func' Signature Block | CompType Body | TypeLit '(' [ Expr [ ',' ] ] ')' ;
Lit = NUM | STR | CHAR ;
CompType = NAME [ '.' NAME ] [ '[' Type { ',' Type } ']' ] | TypeLit ;
TypeLit = '[' [ Expr | '...' ] ']' Type | 'map' '[' Type ']' Type | 'struct' '{' { Field Semi } [ Field ] '}' | 'chan' Type | 'interface' '{' { IfaceElem Semi } [ IfaceElem ] '}' ;
Body = '{' [ Elem { ',' Elem } [ ',' ] ] '}' ;
Elem = [ ( Expr | Body ) ':' ] ( Expr | Body ) ;
SimpleN = ExprN [ INCDEC | '<-' ExprN ] | ExprsN ( ASSIGN | '=' | ':=' ) ExprsN ;
ExprsN = ExprN { ',' ExprN } ;
ExprN = UnaryN { ( BINOP | '*' | '<-' | '|' | '-' | '+' ) UnaryN } ;
UnaryN = { PREFIX | '*' | '<-' | '-' | '+' | '~' } PrimaryN ;
PrimaryN = OperandN { Suffix } ;
OperandN = Lit | NAME | '(' ( Expr | Type ) ')' | 'func' Signature Block | TypeLit ( '(' [ Expr [ ',' ] ] ')' | Body ) ;
"""

PHP = r"""
File = [ INLINE ] { Top } EOF ;
Frag = [ INLINE ] { Top | Member } EOF ;
Semi = ';' | INLINE ;
Top = Stmt | 'namespace' ( [ Name ] '{' { Top } '}' | Name Semi ) | 'use' [ 'function' | 'const' ] UseItem { ',' UseItem } [ ',' ] Semi | '__halt_compiler' '(' ')' Semi ;
UseItem = Name [ 'as' NAME ] | Name '\' '{' GroupItem { ',' GroupItem } [ ',' ] '}' ;
GroupItem = [ 'function' | 'const' ] Name [ 'as' NAME ] ;
Name = [ 'namespace' ] [ '\' ] NAME { '\' WORD } ;
Attrs = { '#[' Attr { ',' Attr } [ ',' ] ']' } ;
Attr = Name [ '(' [ Args ] ')' ] ;
Stmt = Block | Semi | 'const' ConstItem { ',' ConstItem } Semi | FuncDecl | ClassDecl | 'if' '(' Expr ')' ( Stmt { 'elseif' '(' Expr ')' Stmt | 'else' 'if' '(' Expr ')' Stmt } [ 'else' Stmt ] | ':' { Stmt } { 'elseif' '(' Expr ')' ':' { Stmt } } [ 'else' ':' { Stmt } ] 'endif' Semi )
  | 'while' '(' Expr ')' ( Stmt | ':' { Stmt } 'endwhile' Semi ) | 'do' Stmt 'while' '(' Expr ')' Semi
  | 'for' '(' [ Exprs ] ';' [ Exprs ] ';' [ Exprs ] ')' ( Stmt | ':' { Stmt } 'endfor' Semi )
  | 'foreach' '(' Expr 'as' [ Expr '=>' ] [ '&' ] Expr ')' ( Stmt | ':' { Stmt } 'endforeach' Semi )
  | 'switch' '(' Expr ')' ( '{' { Case } '}' | ':' { Case } 'endswitch' Semi ) | ( 'break' | 'continue' ) [ Expr ] Semi | 'return' [ Expr ] Semi
  | 'global' VAR { ',' VAR } Semi | 'static' VAR [ '=' Expr ] { ',' VAR [ '=' Expr ] } Semi | 'echo' Exprs Semi | 'unset' '(' Exprs [ ',' ] ')' Semi
  | 'declare' '(' ConstItem { ',' ConstItem } ')' ( Stmt | ':' { Stmt } 'enddeclare' Semi ) | 'try' Block ( Catch { Catch } [ 'finally' Block ] | 'finally' Block ) | 'goto' NAME Semi | NAME ':' | Expr Semi ;
Catch = 'catch' '(' Name { '|' Name } [ VAR ] ')' Block ;
Case = ( 'case' Expr | 'default' ) ( ':' | Semi ) { Stmt } ;
Block = '{' { Top } '}' ;
Body = '{'@b { Top } '}' ;
ConstItem = WORD '=' Expr ;
FuncDecl = Attrs 'function' [ '&' ] NAME@d Params [ ':' Type ] Body ;
Params = '(' [ Param { ',' Param } [ ',' ] ] ')' ;
Param = Attrs { MODIFIER } [ Type ] [ '&' ] [ '...' ] VAR [ '=' Expr ] [ Hooks ] ;
Type = [ '?' ] TypeAtom { ( '|' | '&' ) TypeAtom } ;
TypeAtom = Name | 'array' | 'callable' | 'static' | 'null' | 'false' | 'true' | 'self' | '(' Type ')' ;
ClassDecl = Attrs ( { MODIFIER } 'class' NAME@c [ 'extends' Name ] [ 'implements' Names ] ClassBody | 'interface' NAME@c [ 'extends' Names ] ClassBody | 'trait' NAME@c ClassBody | 'enum' NAME@c [ ':' Type ] [ 'implements' Names ] ClassBody ) ;
Names = Name { ',' Name } ;
ClassBody = '{' { Member } '}' ;
Member = Attrs ( { MODIFIER | 'static' } ( 'function' [ '&' ] WORD@d Params [ ':' Type ] ( Body | Semi ) ) | ( MODIFIER | 'static' ) { MODIFIER | 'static' } [ Type ] Prop { ',' Prop } ( Semi | Hooks )
  | { MODIFIER } 'const' [ Type ] ConstItem { ',' ConstItem } Semi | 'use' Names ( Semi | '{' { TraitRule } '}' ) | 'case' WORD [ '=' Expr ] Semi ) ;
Prop = VAR [ '=' Expr ] ;
Hooks = '{' { Attrs { MODIFIER } [ '&' ] NAME [ Params ] ( '=>' Expr ';' | Block | ';' ) } '}' ;
TraitRule = [ Name '::' ] WORD ( 'insteadof' Names | 'as' ( [ MODIFIER ] WORD | MODIFIER ) ) Semi ;
Exprs = Expr { ',' Expr } ;
Expr = Unary { ( BINOP | ASSIGN | '=' [ '&' ] | '&' | '|' | '-' | '+' | 'and' | 'or' | 'xor' ) Unary | 'instanceof' Unary | '?' [ Expr ] ':' Unary } ;
Unary = { PREFIX | '-' | '+' | '&' | INCDEC | 'clone' | 'print' | 'include' | 'include_once' | 'require' | 'require_once' | 'throw' | CAST | 'yield' 'from' } ( Postfix { INCDEC } | New | 'yield' [ Expr [ '=>' Expr ] ] | 'match' '(' Expr ')' '{' [ MatchArm { ',' MatchArm } [ ',' ] ] '}' { Select } | Closure | 'exit' ) ;
MatchArm = ( 'default' [ ',' ] | Exprs [ ',' ] ) '=>' Expr ;
Closure = Attrs [ 'static' ] ( 'function' [ '&' ] Params [ 'use' '(' [ [ '&' ] VAR { ',' [ '&' ] VAR } [ ',' ] ] ')' ] [ ':' Type ] Block | 'fn' [ '&' ] Params [ ':' Type ] '=>' Expr ) ;
New = 'new' ( ( Name | 'static' | 'self' | VAR { Prop2 } | '(' Expr ')' ) [ '(' [ Args ] ')' ] { Select } | Attrs { MODIFIER } 'class' [ '(' [ Args ] ')' ] [ 'extends' Name ] [ 'implements' Names ] ClassBody ) ;
Prop2 = ( '->' | '?->' ) WORD | '::' VAR | '[' Expr ']' ;
Postfix = Atom { Select } ;
Select = ( '->' | '?->' ) ( WORD | VAR | '{' Expr '}' ) | '::' ( WORD | VAR | '{' Expr '}' | 'class' ) | '[' [ Expr ] ']' | '(' [ Args ] ')' ;
Args = '...' | Arg { ',' Arg } [ ',' ] ;
Arg = [ '...' ] Expr | WORD ':' Expr ;
Atom = VAR | '$' ( VAR | '{' Expr '}' ) | NUM | STR | Name | 'static' | 'self' | 'null' | 'true' | 'false' | 'isset' '(' Exprs [ ',' ] ')' | 'empty' '(' Expr ')' | 'eval' '(' Expr ')' | 'exit' '(' [ Expr ] ')' | '(' Expr ')' | 'array' '(' [ Items ] ')' | '[' [ Items ] ']' | 'list' '(' [ Items ] ')' ;
Items = [ Item ] { ',' [ Item ] } ;
Item = [ Expr '=>' ] [ '&' ] Expr | '...' Expr ;
"""

RUBY = r"""
File = Body EOF ;
Frag = { Term } { ( Stmt | 'end' ) ( Term { Term } | EOF ) } [ EOF ] ;
Term = ';' | NL ;
Body = { Term } [ Stmt { Term { Term } Stmt } { Term } ] ;
Stmt = Head { ( 'if' | 'unless' | 'while' | 'until' | 'rescue' ) Cond } ;
Head = Cond | 'alias' Sym Sym | 'undef' Sym { ',' Sym } | ( 'BEGIN' | 'END' ) '{' Body '}' | Targets '=' ( Rhs | CmdCall ) ;
Sym = SYM | WORD | OPNAME | GVAR ;
Targets = Target ',' [ Target { ',' Target } [ ',' ] ] | '*' [ Target ] ;
Target = [ '*' ] ( Var | Postfix ( '.' WORD | '[' [ Args ] ']' ) | '(' Targets ')' ) ;
Var = NAME | CONST | IVAR | GVAR ;
Rhs = Arg { ',' Arg } ;
Cond = { 'not' } Phrase { ( 'and' | 'or' ) { NL } { 'not' } Phrase } ;
Phrase = ( Ternary | CmdCall | 'return' [ Rhs | CmdCall ] | 'break' [ Rhs ] | 'next' [ Rhs ] | 'redo' | 'retry' ) [ ( 'in' | '=>' ) Pattern ] ;
Arg = Ternary | '*' Ternary | '**' Ternary | '&' [ Ternary ] | Pair | Lambda ;
Pair = LABEL [ Ternary | CmdCall ] | Ternary '=>' Ternary ;
CmdCall = [ Unaries ] ( ( NAME | CONST | FUNC ) | Postfix ( '.' | '&.' | '::' ) WORD ) CmdArg { ',' { NL } Arg } [ DoBlock ] | 'yield' Rhs | 'super' Rhs | Left ( '=' | ASSIGN ) { NL } ( CmdCall | Rhs ) ;
Unaries = '!' { '!' } | 'defined?' ;
CmdArg = CmdTernary | '*' Ternary | '**' Ternary | '&' Ternary | Pair | Lambda ;
CmdTernary = CmdFlat [ '?' { NL } Ternary { NL } ( ':' | LABEL ) { NL } Ternary ] ;
CmdFlat = CmdUnary { Op { NL } Unary } ;
CmdUnary = ( '-' | '!' | '::' | 'defined?' ) Unary | CmdPrimary { Suffix } ;
Ternary = Flat [ '?' { NL } Ternary { NL } ':' { NL } Ternary | '?' { NL } LABEL { NL } Ternary ] | Left ( '=' | ASSIGN ) { NL } ( Ternary | '*' Ternary ) [ 'rescue' Ternary ] ;
Left = Var | Postfix ( ( '.' | '&.' | '::' ) WORD | '[' [ Args ] ']' ) ;
Flat = Unary { Op { NL } Unary } [ RANGE ] ;
Op = BINOP | RANGE | '*' | '**' | '&' | '|' | '-' | '<' | '?' '!' ;
Unary = { '-' | '!' | '+' | '~' | 'defined?' | '&' | RANGE } Postfix ;
Postfix = Primary { Suffix } ;
Suffix = ( '.' | '&.' ) { NL } ( WORD | FUNC | OPNAME | '(' [ Args ] ')' | '-' | '*' | BINOP ) | '::' ( WORD | FUNC | '(' [ Args ] ')' ) | '(' [ Args ] ')' | '[' [ Args ] ']' | Block ;
Args = { NL } Arg { { NL } ',' { NL } Arg } [ ',' ] { NL } | { NL } CmdCall { NL } ;
Block = '{' [ BlockParams ] Body '}' | DoBlock ;
DoBlock = 'do' [ BlockParams ] BodyRescue 'end' ;
BlockParams = '|' [ Params ] [ ';' NAME { ',' NAME } ] '|' | '||' ;
Params = Param { ',' { NL } Param } [ ',' ] ;
Param = NAME [ '=' NoPipe ] | '*' [ NAME ] | '**' [ NAME | 'nil' ] | '&' [ NAME ] | LABEL [ NoPipe ] | '(' Params ')' | '...' | RANGE ;
NoPipe = Unary { ( BINOP | '-' | '*' | '+' ) Unary } ;
Lambda = '->' [ '(' [ Params ] ')' | Params ] ( '{' Body '}' | 'do' BodyRescue 'end' ) { Suffix } ;
BodyRescue = Body { Rescue } [ 'else' Body ] [ 'ensure' Body ] ;
Rescue = 'rescue' [ Args ] [ '=>' Left ] ( 'then' | Term ) Body ;
Primary = CmdPrimary | '[' [ Args ] { NL } ']' | '{' { NL } [ HashItem { { NL } ',' { NL } HashItem } [ ',' ] ] { NL } '}' | '(' Body ')' ;
HashItem = ( LABEL | STR ':' ) { NL } [ Ternary ] | Ternary { NL } '=>' { NL } Ternary | '**' Ternary ;
CmdPrimary = NAME | CONST | FUNC | IVAR | GVAR | NUM | STR { STR } | SYM | REGEX | 'nil' | 'true' | 'false' | 'self' | '__FILE__' | '__LINE__' | '__method__' | 'super' | 'yield' [ '(' [ Args ] ')' ] | '::' CONST | Lambda
  | '[' [ Args ] { NL } ']' | 'redo' | 'retry' | 'not' '(' Cond ')'
  | 'if' Cond Then Body { 'elsif' Cond Then Body } [ 'else' Body ] 'end' | 'unless' Cond Then Body [ 'else' Body ] 'end'
  | ( 'while' | 'until' ) CondNoDo ( 'do' | Term ) Body 'end' | 'for' Target { ',' Target } 'in' CondNoDo ( 'do' | Term ) Body 'end'
  | 'case' [ Cond ] { Term } ( When { When } | In { In } ) [ 'else' Body ] 'end' | 'begin' BodyRescue 'end'
  | 'class' ( [ '::' ] CONST@c { '::' CONST@c } [ '<' Cond ] | '<<' Cond ) Term BodyRescue 'end' | 'module' CONST@c { '::' CONST@c } BodyRescue 'end' | Def ;
Def = 'def' [ ( 'self' | CONST | NAME | IVAR ) '.' ] DefName ( '(' [ { NL } Params { NL } ] ')' ( '=' { NL } Stmt | BodyRescue 'end' ) | [ Params ] Term BodyRescue 'end' | '=' { NL } Stmt ) ;
DefName = WORD@d [ '=' ] | FUNC@d | OPNAME@d | BINOP@d | '-'@d | '+'@d | '*'@d | '<'@d | '!'@d | '['@x ']'@d [ '=' ] ;
Then = 'then' | Term [ 'then' ] ;
When = 'when' { NL } Arg { ',' { NL } Arg } Then Body ;
In = 'in' Pattern [ ( 'if' | 'unless' ) Cond ] Then Body ;
Pattern = PatTop { ',' PatTop } ;
PatTop = '*' [ NAME ] | '**' ( NAME | 'nil' ) | LABEL [ Pat ] | Pat ;
Pat = PatAtom { '|' PatAtom } [ '=>' NAME ] ;
PatAtom = Unary [ RANGE [ Unary ] ] | '^' ( Var | '(' Cond ')' ) | '[' [ Pattern ] ']' | '{' [ Pattern ] '}' | CONST { '::' CONST } ( '(' [ Pattern ] ')' | '[' [ Pattern ] ']' ) ;
CondNoDo = { 'not' } CondFlat { ( 'and' | 'or' ) { 'not' } CondFlat } ;
CondFlat = Ternary ;
"""

_SCRIPT = r"""
Stmt = Block | ';' | ( 'var' | 'let' ) Binding { ',' Binding } Semi | 'const' ConstBinding { ',' ConstBinding } Semi | 'if' '(' Expr ')' Stmt [ 'else' Stmt ] | 'do' Stmt 'while' '(' Expr ')' [ Semi ] | 'while' '(' Expr ')' Stmt
  | 'for' [ 'await' ] '(' ( [ Expr | ( 'var' | 'let' | 'const' ) Binding { ',' Binding } ] ';' [ Expr ] ';' [ Expr ] | ( ( 'var' | 'let' | 'const' | 'using' ) BindTarget | Left ) ( 'in' Expr | 'of' Assign ) ) ')' Stmt
  | ( 'continue' | 'break' ) [ NAME ] Semi | 'return' [ Expr ] Semi | 'with' '(' Expr ')' Stmt | NAME ':' Stmt | 'throw' Expr Semi | 'debugger' Semi | 'switch' '(' Expr ')' '{' { ( 'case' Expr | 'default' ) ':' { Stmt } } '}'
  | 'try' Block ( 'catch' [ '(' BindTarget %TA ')' ] Block [ 'finally' Block ] | 'finally' Block ) | Function | Decorators Class | StmtExpr Semi %STMT ;
Semi = ';' | ASI ;
Block = '{' { Stmt } '}' ;
FuncBody = '{'@b { Stmt } '}' ;
Binding = BindTarget %DEF %TA [ '=' Assign ] ;
ConstBinding = BindTarget %TA '=' Assign ;
BindTarget = NAME | '{' [ PropPat { ',' PropPat } [ ',' ] ] '}' | '[' [ ElemPat ] { ',' [ ElemPat ] } ']' ;
PropPat = PropName ':' BindElem | NAME [ '=' Assign ] | '...' BindTarget ;
ElemPat = BindElem | '...' BindTarget ;
BindElem = BindTarget [ '=' Assign ] ;
PropName = WORD | STR | NUM | PRIVATE | '[' Assign ']' ;
Params = '(' [ Param { ',' Param } [ ',' ] ] ')' ;
Param = Decorators %ACC [ '...' ] BindTarget %OPT %TA [ '=' Assign ] %THIS ;
Function = [ 'async' ] 'function' [ '*' ] [ NAME@m ] %TP Params %RT FuncBody ;
Decorators = { '@' ( NAME | '(' Expr ')' ) { '.' WORD | '(' [ Args ] ')' } } ;
Class = %ABS 'class' [ NAME@c ] %TP [ 'extends' Call %TARGS ] %IMPL ClassBody ;
ClassBody = '{' { Member | ';' } '}' ;
Member = Decorators %MACC ( [ 'async' ] [ '*' ] ( WORD@m | STR | NUM | PRIVATE@m | '[' Assign ']' ) %OPT %TP Params %RT %BODY | ( 'get' | 'set' ) ( WORD@m | STR | NUM | PRIVATE@m | '[' Assign ']' ) Params %RT %BODY | PropName %DEF %OPT %TA [ '=' Assign ] Semi ) | 'static' Block %MEMBER ;
Expr = Assign { ',' Assign } ;
Assign = Arrow | 'yield' [ [ '*' ] Assign ] | Flat [ '?' Assign ':' Assign ] | Left ( ASSIGN | '=' ) Assign ;
Arrow = [ 'async' ] ( NAME | %TP Params %RT ) '=>' ( FuncBody | Assign ) ;
Flat = Unary { BinOp Unary %AS } ;
BinOp = BINOP | '<' | '>' [ '>' [ '>' ] ] | '*' | '-' | '+' | '|' | '&' | 'in' | 'instanceof' ;
Unary = { Prefix } Postfix ;
Prefix = PREFIX | '-' | '+' | 'await' %CAST ;
Postfix = Call [ INCDEC ] | INCDEC Left ;
Call = ( Primary | New | 'super' ( '(' [ Args ] ')' | '.' WORD | '[' Expr ']' ) | 'import' ( '(' Assign [ ',' Assign ] ')' | '.' WORD ) ) { Select } ;
Select = '.' ( WORD | PRIVATE ) | '?.' ( WORD | PRIVATE | '(' [ Args ] ')' | '[' Expr ']' ) | '[' Expr ']' | '(' [ Args ] ')' | TPL %SEL ;
Args = Arg { ',' Arg } [ ',' ] ;
Arg = [ '...' ] Assign ;
New = 'new' ( '.' WORD | ( Primary | New ) { '.' ( WORD | PRIVATE ) | '[' Expr ']' } %TARGS [ '(' [ Args ] ')' ] ) ;
Left = NAME | ( Call | Call %BANG ) ( '.' ( WORD | PRIVATE ) | '[' Expr ']' ) %BANG | LeftPat | '(' Left ')' ;
LeftPat = '{' [ LeftProp { ',' LeftProp } [ ',' ] ] '}' | '[' [ LeftElem ] { ',' [ LeftElem ] } ']' ;
LeftProp = PropName ':' LeftItem | NAME [ '=' Assign ] | '...' Left ;
LeftElem = LeftItem | '...' Left ;
LeftItem = Left [ '=' Assign ] ;
Primary = Plain | Array | Object | Function | Decorators Class ;
Plain = NAME | 'this' | 'null' | 'true' | 'false' | NUM | STR | REGEX | TPL | '(' Expr ')' | PRIVATE %JSX ;
Array = '[' [ Arg ] { ',' [ Arg ] } ']' ;
Object = '{' [ Prop { ',' Prop } [ ',' ] ] '}' ;
Prop = PropName ':' Assign | NAME | '...' Assign | [ 'async' ] [ '*' ] ( WORD@m | STR | NUM | '[' Assign ']' ) %TP Params %RT FuncBody | ( 'get' | 'set' ) ( WORD@m | STR | NUM | '[' Assign ']' ) Params %RT FuncBody ;
StmtExpr = StmtAssign { ',' Assign } ;
StmtAssign = Arrow | 'yield' [ [ '*' ] Assign ] | StmtUnary %AS { BinOp Unary %AS } [ '?' Assign ':' Assign ] | StmtLeft ( ASSIGN | '=' ) Assign ;
StmtUnary = Prefix { Prefix } Postfix | StmtCall [ INCDEC ] | INCDEC Left ;
StmtCall = ( Plain | Array | New | 'super' ( '(' [ Args ] ')' | '.' WORD | '[' Expr ']' ) | 'import' ( '(' Assign [ ',' Assign ] ')' | '.' WORD ) ) { Select } ;
StmtLeft = NAME | StmtCall ( '.' ( WORD | PRIVATE ) | '[' Expr ']' ) %BANG | '[' [ LeftElem ] { ',' [ LeftElem ] } ']' | '(' Left ')' ;
Module = { Stmt | Import | Export } EOF ;
Import = 'import' %TYPEKW ( STR | ( NAME [ ',' ( NameSpace | Named ) ] | NameSpace | Named ) 'from' STR ) [ ( 'with' | 'assert' ) Object ] Semi ;
NameSpace = '*' 'as' NAME ;
Named = '{' [ Spec { ',' Spec } [ ',' ] ] '}' ;
Spec = %TYPEKW ( WORD | STR ) [ 'as' ( WORD | STR ) ] ;
Export = 'export' ( %TYPEKW ( '*' [ 'as' ( WORD | STR ) ] 'from' STR [ 'with' Object ] Semi | Named [ 'from' STR [ 'with' Object ] ] Semi ) | 'default' ( Function | Decorators Class | StmtDefault Semi %DEFAULT ) | Declared ) ;
StmtDefault = Array | Assign ;
Declared = Function | Decorators Class | ( 'var' | 'let' ) Binding { ',' Binding } Semi | 'const' %CONST { ',' %CONST } Semi %STMT ;
Frag = { Stmt | Import | Export | Member } EOF ;
"""

_JSX = r"""
Jsx = '<' ( '>' { JsxChild } '<' '/' '>' | JsxName { JsxAttr } ( '/' '>' | '>' { JsxChild } '<' '/' JsxName '>' ) ) ;
JsxName = WORD { ( '-' | ':' | '.' ) WORD } ;
JsxAttr = JsxName [ '=' ( STR | '{' Assign '}' | Jsx ) ] | '{' '...' Assign '}' ;
JsxChild = ANY | Jsx | '{' [ [ '...' ] Expr ] '}' | '(' { JsxChild } ')' | '[' { JsxChild } ']' ;
"""

_TYPES = r"""
Type = FuncType | Union [ 'extends' Union '?' Type ':' Type ] ;
FuncType = [ 'abstract' ] [ 'new' ] [ TypeParams ] '(' [ TParam { ',' TParam } [ ',' ] ] ')' '=>' RetType ;
RetType = [ 'asserts' ] ( NAME | 'this' ) [ 'is' Type ] | Type ;
TParam = [ '...' ] BindTarget [ '?' ] [ ':' Type ] | 'this' ':' Type ;
Union = [ '|' | '&' ] TPost { ( '|' | '&' ) TPost } ;
TPost = { 'keyof' | 'unique' | 'readonly' | 'infer' } TPrim { '[' [ Type ] ']' } ;
TPrim = NAME { '.' WORD } [ TypeArgs ] | 'typeof' ( NAME | 'this' | 'import' '(' STR ')' ) { '.' WORD } [ TypeArgs ] | 'this' | 'void' | 'null' | 'true' | 'false' | STR | [ '-' ] NUM | TPL | '(' Type ')' | 'import' '(' STR ')' { '.' WORD } [ TypeArgs ]
  | '[' [ TElem { ',' TElem } [ ',' ] ] ']' | ObjType ;
TElem = [ '...' ] ( WORD [ '?' ] ':' Type | Type [ '?' ] ) ;
ObjType = '{' [ [ TMember ] { TSep [ TMember ] } ] '}' ;
TSep = ';' | ',' | ASI ;
TMember = { 'readonly' | '-' | '+' } ( ( WORD | STR | NUM | '[' Assign ']' ) [ '?' ] ( [ ':' Type ] | [ TypeParams ] '(' [ TParam { ',' TParam } [ ',' ] ] ')' [ ':' RetType ] ) | [ 'new' ] [ TypeParams ] '(' [ TParam { ',' TParam } [ ',' ] ] ')' [ ':' RetType ]
  | '[' NAME ':' Type ']' [ '?' ] ':' Type | '[' NAME 'in' Type [ 'as' Type ] ']' [ ( '-' | '+' ) '?' | '?' ] [ ':' Type ] | ( 'get' | 'set' ) WORD '(' [ TParam ] ')' [ ':' Type ] ) ;
TypeArgs = '<' Type { ',' Type } '>' ;
TypeParams = '<' TypeParam { ',' TypeParam } [ ',' ] '>' ;
TypeParam = { 'const' | 'in' | 'out' } NAME [ 'extends' Type ] [ '=' Type ] ;
TsDecl = 'interface' NAME@c [ TypeParams ] [ 'extends' Heritage { ',' Heritage } ] ObjType | 'type' NAME [ TypeParams ] '=' Type Semi | [ 'const' ] 'enum' NAME@c '{' [ EnumItem { ',' EnumItem } [ ',' ] ] '}'
  | 'declare' ( TsDecl | Function2 | Decorators Class | ( 'var' | 'let' | 'const' ) Binding { ',' Binding } Semi | 'global' TsBlock ) | ( 'namespace' NAME { '.' NAME } | 'module' ( STR | NAME { '.' NAME } ) ) TsBlock | Function2 | 'import' NAME '=' ( 'require' '(' STR ')' | NAME { '.' WORD } ) Semi ;
Heritage = NAME { '.' WORD } [ TypeArgs ] ;
Function2 = [ 'async' ] 'function' [ '*' ] NAME [ TypeParams ] Params [ ':' RetType ] Semi ;
EnumItem = ( NAME | STR ) [ '=' Assign ] ;
TsBlock = '{' { Stmt | Import | Export } '}' | Semi ;
"""


def script(typed=False, jsx=False):
    """The ECMAScript grammar, with types and JSX elements where asked for."""
    ts = {
        "%TA": "[ ':' Type ]", "%RT": "[ ':' RetType ]", "%TP": "[ TypeParams ]", "%OPT": "[ '?' ]", "%DEF": "[ '!' ]", "%ABS": "[ 'abstract' ]", "%IMPL": "[ 'implements' Heritage { ',' Heritage } ]", "%TARGS": "[ TypeArgs ]",
        "%ACC": "{ MODIFIER | 'readonly' | 'override' }", "%MACC": "{ MODIFIER | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor' }", "%BODY": "( FuncBody | Semi )", "%MEMBER": "| { MODIFIER | 'static' | 'readonly' } '[' NAME ':' Type ']' ':' Type Semi",
        "%AS": "{ ( 'as' | 'satisfies' ) ( Type | 'const' ) }", "%CONST": "Binding", "%THIS": "| 'this' ':' Type", "%CAST": "" if jsx else "| '<' ( Type | 'const' ) '>'", "%SEL": "| '!' | TypeArgs ( '(' [ Args ] ')' | TPL )", "%BANG": "{ '!' }", "%STMT": "| TsDecl", "%TYPEKW": "[ 'type' ]", "%DEFAULT": "| 'interface' NAME [ TypeParams ] ObjType | Function2",
    }
    text = _SCRIPT
    for k in sorted({*ts, "%JSX"}, key=len, reverse=True):
        text = text.replace(k, ("| Jsx" if jsx else "") if k == "%JSX" else ts[k] if typed else {"%MACC": "[ 'static' ]", "%BODY": "FuncBody", "%CONST": "ConstBinding"}.get(k, ""))
    if typed:
        text = text.replace("Flat = Unary {", "Flat = Unary %AS {".replace("%AS", ts["%AS"])).replace("Export = 'export' (", "Export = 'export' ( '=' Expr Semi | 'as' 'namespace' NAME Semi |")
    else:
        text += "Script = { Stmt } EOF ;"
    return text + (_TYPES if typed else "") + (_JSX if jsx else "")
